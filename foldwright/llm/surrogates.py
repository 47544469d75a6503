"""Surrogates for personal data: every detected entity gets a keyed replacement of its own type, script and format.

Detected are e-mail addresses, phone numbers, card numbers, social security numbers, bank account numbers, network
addresses, access keys and secrets, and names of persons behind a form of address or a common given name. The surrogate
of an entity is a function of the key and the entity alone, so the same person stays the same in all texts, however the
entity is written there: its characters are drawn anew within their classes, and the separators of each mention stay. Card and
account numbers keep their check digits, private network addresses stay private, given names come from the list of the
same gender and script, surnames are made of syllables of the same script.

Surrogates are checked against each other and against all entities of the corpus. Where two entities of a type meet, or
a surrogate is itself an entity, one of them is drawn again until none meet.

All of this is DataFrame expressions. Texts without entities pass a single filter and are not shuffled; equal texts with
entities are replaced once.

Defined results: a null text stays null and an empty one empty; rows are neither lost nor merged, whatever repeats;
an empty table gives an empty result; other columns pass through ``replaced`` unchanged, but for n_chars, which follows
the text. Phone numbers of two or three groups that could be quantities, and those in one run of digits, are found behind a word
for a phone only; compressed network addresses from four hexadecimal digits on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import free_name, materialize

KEY = "foldwright surrogates"
#: Draws of one entity before the space of its format counts as used up.
DRAWS = 60

# Forms of address and common given names, by script and gender.
TITLES = ("Mr Mrs Ms Miss Mx Dr Prof Sir Madam Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Don Doña "
          "Господин Госпожа Кύριος Κυρία").split()
GIVEN = {
    "latin f": "Alice Anna Anne Barbara Carmen Caroline Claire Elena Elizabeth Emily Emma Hannah Helen Isabel Julia Karen "
               "Laura Linda Lucía Maria María Marie Mary Patricia Sarah Sofia Sophie Susan Ursula Victoria".split(),
    "latin m": "Alexander Andreas Antonio Carlos Charles Daniel David Francisco Hans James Jean John José Jürgen Klaus Louis "
               "Luis Manuel Mark Michael Miguel Pablo Paul Peter Pierre Robert Stefan Thomas William Wolfgang".split(),
    "cyrillic f": "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    "cyrillic m": "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    "greek f": "Άννα Ελένη Μαρία Σοφία Κατερίνα Ιωάννα".split(),
    "greek m": "Γιώργος Γιάννης Νίκος Δημήτρης Κώστας Παύλος".split(),
}
SYLLABLES = {
    "latin": [c + v for c in "b d f g k l m n p r s t v".split() for v in "a e i o u".split()],
    "cyrillic": [c + v for c in "б в г д з к л м н п р с т".split() for v in "а е и о у".split()],
    "greek": [c + v for c in "β γ δ κ λ μ ν π ρ σ τ".split() for v in "α ε η ι ο".split()],
}
NAME_WORD = r"\p{Lu}\p{Ll}++(?:[-'’]\p{Lu}\p{Ll}++)*+"
ANY_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
NAME = (rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? (?:(?:{ANY_GIVEN}) )?{NAME_WORD}"
        rf"|(?:{ANY_GIVEN}) {NAME_WORD})")
SECRET_HEAD = r"(?:(?i:api[_-]?key|access[_-]?key|auth[_-]?token|token|password|passwd|pwd|secret)\b\s{0,3}[=:]\s{0,3}[\"']?)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kind and pattern of each type of entity, the more specific first.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,24}",
    "secret": rf"(?<![A-Za-z0-9]){SECRET_HEAD}[A-Za-z0-9+/_.-]{{8,}}",
    "access": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?:gh[pousr]_|sk[-_]|pk[-_]|xox[abprs]-)[A-Za-z0-9_-]{16,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"
            r"|(?<![0-9A-Za-z:])(?=(?::{0,2}[0-9a-fA-F]){4})(?=[a-fA-F:]*\d)(?:(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}"
            r"|::[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6}|(?:[0-9a-fA-F]{1,4}:){1,7}:)(?![0-9A-Za-z:]|\.\d)",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.\d)",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|\+\d{8,15}"
             r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z+])(?<!\d[ .,/-])(?:\d{3} \d{3} \d{4}|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /]\d{5,8}|[6-9]\d{2}(?: \d{2}){3})"
             r"(?![0-9A-Za-z]|[ .,/-]\d)",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z])",
    "name": NAME,
}
#: National numbers that a quantity could look like too, and a word in front that tells them apart.
NATIONAL = r"(?=(?:[ ./-]?\d){7,13}(?![ ./-]?\d))(?:\d{2,5}(?:[ ./-]\d{2,8}){1,5}|\d{7,13})(?![0-9A-Za-z])"
PHONE_WORDS = ("tel telefon telefono teléfono telefonnummer téléphone telephone phone mobile mobil móvil handy fax call cell "
               "rufen appelez llame").split()
CALLED = rf"(?=\d)(?<=\b(?iu:{'|'.join(PHONE_WORDS)})[.:]{{0,2}}[ ]{{0,2}}){NATIONAL}"
#: No pattern matches behind one of these letters, which spares them most places of a text.
ANY = r"(?<![A-Za-z])(?:" + "|".join(f"(?:{p})" for p in [*PATTERNS.values(), CALLED]) + ")"


def _kind(raw: Column) -> Column:
    """The first type whose pattern the whole mention matches."""
    return F.coalesce(*(F.when(raw.rlike(f"^(?:{p})$"), k) for k, p in [*PATTERNS.items(), ("phone", NATIONAL)]))


def _parts(mentions: DataFrame) -> DataFrame:
    """kind, head (kept as written), given (name from the list), body (to be drawn anew) and norm of each ``raw``."""
    raw, kind = F.col("raw"), F.col("kind")
    title = rf"^((?:(?:{'|'.join(TITLES)})\.? )?)((?:(?:{ANY_GIVEN}) )?)(.*)$"
    head = (F.when(kind == "name", F.regexp_extract(raw, title, 1))
            .when(kind == "secret", F.regexp_extract(raw, f"^{SECRET_HEAD}", 0))
            .when(kind == "access", F.regexp_extract(raw, r"^(?:AKIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abprs]-)", 0))
            .otherwise(""))
    given = F.when(kind == "name", F.trim(F.regexp_extract(raw, title, 2))).otherwise("")
    out = (mentions.withColumn("kind", _kind(raw)).withColumn("head", head).withColumn("given", given)
           .withColumn("body", F.when(kind == "name", F.regexp_extract(raw, title, 3))
                       .otherwise(F.expr("substring(raw, length(head) + 1)"))))
    body = F.col("body")
    norm = (F.when(kind.isin("email", "name", "ipv6"), F.lower(body)).when(kind.isin("secret", "access", "ip"), body)
            .otherwise(F.regexp_replace(body, r"[^\p{L}\p{N}]", "")))
    return out.withColumn("norm", norm)


def _draw(seed: Column, place: Column, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(n) if isinstance(n, int) else n).cast("int")


def _letter(seed: Column, place: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), _draw(seed, place, len(alphabet)) + 1, F.lit(1))


LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _scrambled(text: Column, seed: Column) -> Column:
    """``text`` with every letter and digit drawn anew within its class and script."""
    classes = [("[0-9]", DIGITS), ("[a-z]", LOWER), ("[A-Z]", UPPER), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
               (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{Ll}", "àáâäçèéêëìíîïñòóôöùúûü"),
               (r"\p{Lu}", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ")]

    def drawn(c: Column, i: Column) -> Column:
        pick = reduce(lambda w, x: w.when(c.rlike(x[0]), _letter(seed, i, x[1])), classes[1:],
                      F.when(c.rlike(classes[0][0]), _letter(seed, i, classes[0][1])))
        return pick.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), drawn), "")


def _luhn_sum(digits: Column) -> Column:
    """The checksum of a number whose last digit is its check digit."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _iban_rest(text: Column) -> Column:
    """The remainder by 97 of an account number whose country and check digits have been put last."""
    digits = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string"))
                                      .otherwise(c)), "")
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _syllable(seed: Column, syllables: list[str]) -> Callable[[Column], Column]:
    every = F.array(*map(F.lit, syllables))
    return lambda i: F.get(every, _draw(seed, i, len(syllables)))


def _core(kind: Column, norm: Column, tries: Column, key: str) -> Column:
    """The normalised surrogate of an entity at a number of earlier tries."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, tries.cast("string")), 256)
    drawn = _scrambled(norm, seed)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    reserved = r"(?:^|\.)example\.(?:com|net|org)$"
    sub = F.regexp_replace(domain, r"\.?[^.]*\.[^.]*$", "")
    own = F.when(domain.rlike(reserved), F.concat(_scrambled(sub, F.concat(F.lit(key), domain)), F.when(sub != "", ".").otherwise(""),
                                                  F.regexp_extract(domain, r"example\.[a-z]+$", 0))).otherwise(
        F.concat(_scrambled(F.regexp_replace(domain, r"\.[^.]*$", ""), F.concat(F.lit(key), domain)), F.lit(".example.org")))
    email = F.concat(_scrambled(local, seed), F.lit("@"), own)
    hexes = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), _letter(seed, i, HEX)).otherwise(c)), "")
    secret = F.when(norm.rlike("^[0-9a-f]+$"), hexes).otherwise(drawn)
    octets = [_draw(seed, F.lit(k), 254) + 1 for k in range(4)]
    start = (F.when(norm.rlike(r"^(?:10|127)\."), F.array(F.substring_index(norm, ".", 1)))
             .when(norm.rlike(r"^192\.168\."), F.array(F.lit("192"), F.lit("168")))
             .when(norm.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), F.array(F.lit("172"), F.substring_index(F.substring_index(norm, ".", 2), ".", -1)))
             .otherwise(F.array((11 + _draw(seed, F.lit(9), 110)).cast("string"))))
    address = F.array_join(F.slice(F.concat(start, F.array(*(o.cast("string") for o in octets))), 1, 4), ".")
    american = norm.rlike(r"^1?[1-9]\d{9}$")
    body = F.when(american, F.expr("right(norm, 10)"))
    phone = F.when(american, F.concat(
        F.expr("substring(norm, 1, length(norm) - 10)"), (2 + _draw(seed, F.lit(0), 8)).cast("string"), _letter(seed, F.lit(1), DIGITS),
        _letter(seed, F.lit(2), DIGITS), F.when(F.substring(body, 4, 3) == "555", F.lit("555")).otherwise(F.concat(
            (2 + _draw(seed, F.lit(3), 8)).cast("string"), _letter(seed, F.lit(4), DIGITS), _letter(seed, F.lit(5), DIGITS))),
        *(_letter(seed, F.lit(k), DIGITS) for k in range(6, 10)))).otherwise(
        F.concat(F.substring(norm, 1, 2), _scrambled(F.substring(norm, 3, 99), seed)))
    trunk = F.concat(F.substring(norm, 1, 1), _scrambled(F.expr("substring(norm, 2, length(norm) - 2)"), seed))
    check = F.pmod(10 - _luhn_sum(F.concat(trunk, F.lit("0"))), F.lit(10)).cast("string")
    right = _luhn_sum(norm) % 10 == 0
    card = F.concat(trunk, F.when(right, check).otherwise(F.pmod(check.cast("int") + 1 + _draw(seed, F.lit(99), 9), F.lit(10)).cast("string")))
    social = F.concat(F.lit("9"), _scrambled(F.substring(norm, 2, 99), seed))
    country, account = F.substring(norm, 1, 2), _scrambled(F.substring(norm, 5, 99), seed)
    iban = F.concat(country, F.lpad((98 - _iban_rest(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    ipv6 = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(_letter(seed, i, HEX))), "")
    script = _script(norm)
    places = F.sequence(F.lit(0), 2 + F.floor(tries / 2).cast("int"))
    name = F.coalesce(*(F.when(script == s, F.array_join(F.transform(places, _syllable(seed, each)), ""))
                        for s, each in SYLLABLES.items()))
    by_kind = {"email": email, "secret": secret, "access": drawn, "iban": iban, "ipv6": ipv6, "ip": address, "ssn": social,
               "phone": phone, "card": card, "name": name}
    return F.coalesce(*(F.when(kind == k, c) for k, c in by_kind.items()))


def _given_names(key: str) -> dict[str, str]:
    """Every given name of the lists and another one of its gender and script; no two get the same."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
        out.update(zip(order, order[1:] + order[:1]))
    return out


def _rendered(key: str) -> Column:
    """A mention written with the surrogate: its case and separators stay."""
    body, core, kind = F.col("body"), F.col("core"), F.col("kind")
    # The k-th letter or digit of the mention gives way to the k-th character of the surrogate.
    spread = F.aggregate(F.split(body, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda a, c: F.struct(
        F.concat(a["out"], F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(core, a["at"], F.lit(1))).otherwise(c)).alias("out"),
        (a["at"] + F.when(c.rlike(r"[\p{L}\p{N}]"), 1).otherwise(0)).alias("at")))["out"]
    given = F.create_map(*(F.lit(x) for pair in _given_names(key).items() for x in pair))
    cased = F.when(body == F.upper(body), F.upper(core)).otherwise(core)
    return F.concat("head", F.when(F.col("given") != "", F.concat(F.element_at(given, F.col("given")), F.lit(" "))).otherwise(""),
                    F.when(kind == "name", F.initcap(core)).when(kind == "email", cased)
                    .when(kind.isin("phone", "card", "ssn", "iban"), spread).otherwise(core))


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, norm, core for distinct ``entities`` (kind, norm): distinct surrogates that are no entities themselves."""
    drawn = entities.select("kind", "norm", F.lit(0).alias("tries"))
    for _ in range(DRAWS):
        drawn = materialize(drawn.select("kind", "norm", "tries", _core(F.col("kind"), F.col("norm"), F.col("tries"), key)
                                         .alias("core")), "surrogates")
        meeting = (drawn.groupBy("kind", "core").agg(F.min(F.struct("tries", "norm")).alias("stays"), F.count("*").alias("n"))
                   .where("n > 1").select("kind", "core", F.col("stays.norm").alias("stays")))
        known = drawn.select("kind", F.col("norm").alias("core")).join(drawn.select("kind", "core"), ["kind", "core"], "left_semi")
        again = materialize(
            drawn.join(meeting, ["kind", "core"]).where("norm != stays").select("kind", "norm")
            .unionByName(drawn.join(known, ["kind", "core"], "left_semi").select("kind", "norm")).distinct()
            .withColumn("again", F.lit(1)), "met")
        if again.isEmpty():
            return drawn.select("kind", "norm", "core")
        drawn = drawn.join(again, ["kind", "norm"], "left").select(
            "kind", "norm", (F.col("tries") + F.coalesce("again", F.lit(0))).alias("tries"))
    raise ValueError("the formats of the entities have no room for as many distinct surrogates")


def replaced(docs: DataFrame, key: str = KEY, counted: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts; ``counted`` names a column for the number of mentions."""
    digest, new, n = (free_name(docs, x) for x in ("digest", "new_text", "mentions"))
    has = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    texts = materialize(docs.where(has).select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"])
                        .withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0))), "texts-with-entities")
    mentions = materialize(_parts(texts.select("digest", F.posexplode("found").alias("at", "raw"))), "mentions")
    cores = surrogate_table(mentions.select("kind", "norm").distinct(), key)
    written = (mentions.join(cores, ["kind", "norm"]).groupBy("digest")
               .agg(F.sort_array(F.collect_list(F.struct("at", _rendered(key).alias("out")))).alias("outs")))
    between = F.split("text", ANY, -1)
    text = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(F.col("outs"), i)["out"], F.lit("")))), "")
    changed = materialize(texts.drop("found").join(written, "digest").select(
        F.col("digest").alias(digest), text.alias(new), F.size("outs").alias(n)), "replaced-texts")
    columns = [F.col(new).alias("text") if c == "text" else F.length(new).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`")
               for c, t in docs.dtypes]
    with_new = docs.where(has).withColumn(digest, F.sha2("text", 256)).drop("text").join(changed, digest)
    return with_new.select(*columns, *([F.col(n).alias(counted)] if counted else [])).unionAll(docs.where(~has).select("*", *([F.lit(0).alias(counted)] if counted else [])))
