"""Spelling forms, token alignment and URL models against brute force, with nulls, empty, long and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from foldwright.llm import spelling_forms, token_alignment, url_models
from tests.compare import connect, differences

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, rows, kind="long"):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows],
                                 f"doc_id {kind}, text string, word string, n long, key string")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def forms(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, form = {}, {}
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = (n, len(around), words[best] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def found_forms(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def variants():
    """Words of few letters, so that many are near; chains of forms; letters outside ASCII; a frequent start."""
    draws = random.Random(3)
    stems = ["".join(draws.choice("abÈ×") for _ in range(draws.randrange(7, 9))) for _ in range(500)]
    rows = [(None, None), (1, ""), (2, "!? 12 x"), (None, "Anderswo anderswo")]
    rows += [(k, " ".join(draws.choice(stems) for _ in range(60))) for k in range(40)]
    rows += [(100 + k, "Settlement " * 30 + "settlemint " * 2) for k in range(5)] * 2
    rows += [(200, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa " + "z" * 3000 + " " + "z" * 3000 + " " + "z" * 3001 + " " + "z" * 3001)]
    rows += [(300, "abbbbbb " * 2000 + "abbbbbbc " * 150 + "abbbbbbcd " * 12 + "abbbbbcd abbbbbcd")]
    return rows


@pytest.mark.parametrize("limit", [4000, 3])
def test_spelling_forms(spark, variants, limit):
    want = forms(variants)
    assert found_forms(spelling_forms.spelling_forms(documents(spark, variants), limit)) == want
    assert any(x[0] and x[0] != x[1] for x in want.values()) and sum(x[3] for x in want.values()) > 100


def test_spelling_forms_of_other_tables(spark):
    assert found_forms(spelling_forms.spelling_forms(documents(spark, []))) == {}
    rows = [("a", "mornings"), ("b", "mornings"), ("c", "morning morning")]
    assert found_forms(spelling_forms.spelling_forms(documents(spark, rows, "string"))) == forms(rows)


def test_acceptor_is_minimal_and_composes_all_pairs():
    draws = random.Random(5)
    words = sorted({"".join(draws.choice("abc") for _ in range(draws.randrange(1, 7))) for _ in range(400)})
    acceptor = spelling_forms.Acceptor(words, 0)
    assert len({(f, s) for f, s in zip(acceptor.final, acceptor.steps)}) == len(acceptor.steps) < len(words)
    got = [tuple(sorted(p)) for p in acceptor.pairs("")]
    assert sorted(got) == sorted((u, v) for k, u in enumerate(words) for v in words[k + 1:] if near(u, v))
    assert list(spelling_forms.Acceptor([], 0).pairs("")) == []


def alignment(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = {c: k for c, k in token_alignment.byte_alphabet().items()}
    docs = []
    for _, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(of[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()
                   for k, p in ((k, b.id_to_piece(k)) for k in ids_b)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        ends_a, ends_b = list(np.cumsum([len(x) for x in bytes_a])), list(np.cumsum([len(x) for x in bytes_b]))
        links = [(x, y) for x, e in zip(ids_a, ends_a) for y, f in zip(ids_b, ends_b) if e == f]
        cuts, groups, low = sorted(set(ends_a) & set(ends_b)), [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, e in zip(ids_a, ends_a) if low < e <= cut) + "|" +
                          ",".join(str(y) for y, e in zip(ids_b, ends_b) if low < e <= cut))
            low = cut
        docs.append((ids_a, ids_b, links, groups))
    counts = Counter(x for d in docs for x in d[2])
    most = defaultdict(int)
    for (x, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted((str(i), len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for (i, _), (a, b, x, g) in zip(rows, docs))


def found_alignment(df):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                  for r in df.collect())


TEXTS = ["the river and the stone", "", None, "a", " two  spaces\tand\nlines ", "<|endoftext|> </s> <unk> <0x41>", "Über die Brücke, ñandú! 東京 😀",
         "trailing ", "a▁b", "e\u0301clair", "x" * 300, "\u0000 null", "the river and the stone", " ", "  ", "\n", "a \n b", "a\n b\t c  d",
         "x\u00a0 y \u00a0z", "a\u3000 b \x1c c\x85 d", "n 's 't 're ' s", "a ² b ½ c _ d ٣ e", "é ﬁ ﬁ", "one " * 300 + "\u2581two", "word" * 3000 + " end"]


def test_token_alignment(spark):
    draws = random.Random(8)
    words = "the river Übergang señor 12345 lighthouse don't ... 東京 antidisestablishmentarianism".split()
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (0, TEXTS[0])]
    rows += [(50 + k, " ".join(draws.choice(words) for _ in range(draws.randrange(1, 400)))) for k in range(30)]
    want = alignment(rows)
    assert found_alignment(token_alignment.align_tokens(documents(spark, rows), A, B)) == want
    assert found_alignment(token_alignment.align_tokens(documents(spark, rows).repartition(1), A, B, words=5)) == want
    assert any(x[1] == 0 for x in want) and any(x[3] < min(x[1], x[2]) for x in want)
    assert found_alignment(token_alignment.align_tokens(documents(spark, []), A, B)) == []
    text_ids = [("k", "the river"), (None, None)]
    assert found_alignment(token_alignment.align_tokens(documents(spark, text_ids, "string"), A, B)) == alignment(text_ids)


def test_lockstep_against_sets_of_ends():
    draws = np.random.default_rng(2)
    ends = [[np.unique(draws.integers(1, 60, draws.integers(0, 30))) for _ in range(50)] for _ in "ab"]
    flat = [np.concatenate(x) for x in ends]
    stops = [np.cumsum([len(e) for e in x]) for x in ends]
    got_a, got_b = token_alignment.lockstep(flat[0], flat[1], *stops)
    doc = [np.repeat(np.arange(50), [len(e) for e in x]) for x in ends]
    want = [(d, e) for d in range(50) for e in sorted(set(ends[0][d]) & set(ends[1][d]))]
    assert [(doc[0][k], flat[0][k]) for k in got_a] == want == [(doc[1][k], flat[1][k]) for k in got_b]


def test_linked_ids_are_bounded_by_the_vocabularies():
    pair = token_alignment.tokenizers_of(A, B)
    a, b = pair.a, pair.b
    assert a.lengths.sum() + b.lengths.sum() < 600_000 and (a.lengths > 0).all() and (b.lengths > 0).all()


def test_words_give_the_ids_of_whole_texts(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + TEXTS
    texts = [t for t in texts if t]
    pair = token_alignment.tokenizers_of(A, B)
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    for text in texts:
        words, counts = pair.numbered([text])
        if not counts[0]:
            continue
        assert pair.a.of(words)[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert pair.b.of(words)[0].tolist() == b.encode(text)


PAGES = [(1, "https://a.example.com/de/1"), (2, "http://A.Example.COM/en/x?y#z"), (3, "https://www.example.com/en/"), (4, "ftp://x.net/es/a"),
         (5, "ftp://x.net/fr"), (6, "x://com"), (7, "x://com?/de"), (8, None), (9, ""), (10, "no scheme.com/"), (None, "https://a.example.org/en/1"),
         (12, "https://a.example.org/en/1"), (12, "https://notcom/"), (13, "https://b.www.example.com/en/q://c.net/es/"), (14, "u://ÀB.com/Ä😀"),
         (15, "https://x.org/" + "ab/" * 5000), (16, "https://example.com.net/es/\n"), (17, "s://com:80/"), (18, "https://xexample.com/en/")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "r", 1) for i, u in rows], "page_id long, url string, html string, rule string, gram int")


def many_urls(seed):
    draws = random.Random(seed)
    hosts = ["alpha.example.com", "beta.example.net", "gamma.example.org", "casino.example.net", "com", "net"]
    return [(k, f"http{'s' * draws.randrange(2)}://{draws.choice(hosts)}/{draws.choice(['en', 'de', 'es', 'fr'])}/{draws.randrange(300)}") for k in range(500)]


def judged(rows, order):
    """The method in plain Python: the verdict and score of each row."""
    def split(url):
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = found.groups() if found else ("", "")
        return "".join(c.lower() if c.isascii() else c for c in host), path

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in url_models.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    known = {u or "": rule(*split(u))[1] for _, u in rows}
    held = {t: v is not None and hashlib.md5(t.encode()).hexdigest()[0] in url_models.HELD_OUT for t, v in known.items()}
    runs = {t: [("\x02" * order + t + "\x03")[k:k + order + 1] for k in range(len(t) + 1)] for t in known}
    letters = len({g[-1] for x in runs.values() for g in x})
    seen, kinds = defaultdict(int), defaultdict(set)
    for t, v in known.items():
        for g in runs[t] if v and not held[t] else []:
            for k in range(order + 1):
                seen[v, g[order - k:]] += 1
                seen[v, g[order - k:order], "context"] += 1
                kinds[v, g[order - k:order]].add(g[-1])

    def probability(v, g):
        p = 1.0 / letters
        for k in range(order + 1):
            context = g[order - k:order]
            n, t = seen[v, context, "context"], len(kinds[v, context])
            p = p if n + t == 0 else (seen[v, g[order - k:]] + t * p) / (n + t)
        return p

    weight = {g: math.floor(abs(w := url_models.PARTS * (math.log(probability("allow", g)) - math.log(probability("block", g)))) + 0.5)
              * (1 if w > 0 else -1) for x in runs.values() for g in x}
    score = {t: math.floor(sum(weight[g] for g in x) / len(x) / url_models.STEP) for t, x in runs.items()}
    ok, bad = [score[t] for t in known if held[t] and known[t] == "allow"], [score[t] for t in known if held[t] and known[t] == "block"]
    least = 0
    if ok and bad:
        least = max(set(ok + bad), key=lambda s: (sum(x >= s for x in ok) * len(bad) + sum(x < s for x in bad) * len(ok), -abs(s), -s))
    out = []
    for i, u in rows:
        host, path = split(u)
        name, verdict = rule(host, path)
        s = score[u or ""]
        out.append((str(i), host, path, name, verdict or ("allow" if s >= least else "block"), None if name else s / 1000))
    return sorted(out, key=str)


def found_urls(df):
    return sorted(((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [PAGES, many_urls(1), many_urls(2) + PAGES * 2, PAGES[-4:-3], [(1, "https://x.org/a")] * 3])
def test_urls_against_plain_python(spark, rows):
    got = found_urls(url_models.judge_urls(pages(spark, rows)))
    assert got == judged(rows, url_models.ORDER)
    assert got == found_urls(url_models.judge_urls(pages(spark, rows).repartition(5)))


def test_urls_without_broadcast(spark, monkeypatch):
    rows = many_urls(3) + PAGES
    monkeypatch.setattr(url_models, "broadcast_within", lambda df: df)
    monkeypatch.setattr(url_models, "HOT_ROWS", 50)
    assert found_urls(url_models.judge_urls(pages(spark, rows))) == judged(rows, url_models.ORDER)


def test_urls_of_an_empty_table(spark):
    assert found_urls(url_models.judge_urls(pages(spark, []))) == []


def test_models_tell_classes_apart_that_no_rule_decides(spark):
    rows = many_urls(4)
    scored = {r["text"]: r for r in url_models.scores(
        spark.createDataFrame([(u, "block" if "casino" in u else "allow", k % 4 == 0) for k, (_, u) in enumerate(rows)],
                              "text string, verdict string, held boolean").distinct()).collect()}
    held = [(r["score"], r["verdict"]) for r in scored.values() if r["held"]]
    assert min(s for s, v in held if v == "allow") > max(s for s, v in held if v == "block")


def test_url_twin(spark):
    con = connect("/root/testdata/sf0.001")
    got = url_models.judge_urls(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert differences(got, con, url_models.twin()) == []
