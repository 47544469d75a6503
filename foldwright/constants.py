"""Column names, thresholds and lookup tables shared by every operator.

Everything in this module is a fixed value: results only agree with the published
ones when these names, numbers and texts are the same.
"""

# Column names and the seed.
TARGET = "Result"
LABEL = "is_phishing"
GROUP = "group_id"
SPLIT = "split"
META_COLS = [LABEL, GROUP, SPLIT]
ROW = "row_index"
SEED = 42

# Target code of the positive class and the two class names.
POSITIVE_CODE = -1
POSITIVE_CLASS = "phishing"
NEGATIVE_CLASS = "legitimate"

# Folds, thresholds and the log-loss clip.
N_FOLDS = 5
SUSPICIOUS_AUC = 0.85
DECISION_THRESHOLD = 0.5
LOG_LOSS_CLIP = 1e-15
TEST_SHARE = 0.2

# Documented leaky features of the website table (feature, category, reason).
LEAKY_FEATURES = [
    ("Statistical_report", "label-source leakage",
     "Host is looked up in PhishTank / StopBadware top-phishing lists; PhishTank is also "
     "the source of the phishing labels, so the feature partially encodes the target."),
    ("web_traffic", "third-party reputation",
     "Alexa traffic rank. Legitimate samples were drawn from popular-site lists, so rank "
     "encodes how a sample was collected (same pattern as PhiUSIIL's URLSimilarityIndex)."),
    ("Page_Rank", "third-party reputation",
     "Google PageRank lookup (service discontinued); popularity proxy tied to sampling source."),
    ("Google_Index", "third-party reputation",
     "Requires querying Google's index; new phishing pages are unindexed by construction."),
    ("Links_pointing_to_page", "third-party reputation",
     "Backlink count from an external link index; popularity proxy, unavailable at first sight."),
    ("age_of_domain", "WHOIS / crawl-time dependent",
     "WHOIS lookup whose value depends on when the crawl happened relative to the report "
     "date; threshold (6 months) was tuned on the labelled dataset."),
    ("Domain_registeration_length", "WHOIS / crawl-time dependent",
     "WHOIS expiry lookup; threshold (1 year) tuned on the labelled dataset."),
    ("DNSRecord", "WHOIS / crawl-time dependent",
     "Empty WHOIS/DNS record often reflects a domain already taken down after being "
     "reported, i.e. post-label information."),
    ("Abnormal_URL", "WHOIS / crawl-time dependent",
     "Compares the host against the WHOIS-registered identity (third-party lookup)."),
    ("SSLfinal_State", "third-party reputation",
     "Certificate issuer checked against a hand-picked 'trusted CA' list plus certificate age "
     "threshold tuned on the dataset; a curated reputation score, not a URL/page property."),
]

# Page features, dropped as well in url-only mode, with their category and reason.
PAGE_FEATURES = [
    "Favicon", "port", "Request_URL", "URL_of_Anchor", "Links_in_tags", "SFH",
    "Submitting_to_email", "Redirect", "on_mouseover", "RightClick", "popUpWidnow", "Iframe",
]
PAGE_CATEGORY = "page/host content (url-only mode)"
PAGE_REASON = "Requires fetching the page or probing the host; not computable from the URL string."

# Metric code -> display label, in display order.
METRIC_LABELS = {
    "accuracy": "Accuracy", "balanced_accuracy": "Balanced accuracy",
    "precision": "Precision (PPV)", "recall": "Recall (sensitivity, TPR)",
    "specificity": "Specificity (TNR)", "npv": "Negative predictive value",
    "f1": "F1 (phishing)", "f1_macro": "F1 macro", "f1_weighted": "F1 weighted", "f2": "F2",
    "false_positive_rate": "False positive rate", "false_negative_rate": "False negative rate",
    "mcc": "Matthews corr. coef.", "cohen_kappa": "Cohen's kappa", "roc_auc": "ROC-AUC",
    "pr_auc": "PR-AUC (avg. precision)", "log_loss": "Log loss", "brier_score": "Brier score",
}

# Columns of a metric record, in output order.
METRIC_COLUMNS = [
    "n_samples", "n_phishing", "n_legitimate", "threshold",
    "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "npv",
    "f1", "f1_macro", "f1_weighted", "f2", "false_positive_rate", "false_negative_rate",
    "mcc", "cohen_kappa", "roc_auc", "pr_auc", "log_loss", "brier_score",
    "tp", "fp", "tn", "fn",
]

# Those of them that count rows.
METRIC_COUNTS = ["n_samples", "n_phishing", "n_legitimate", "tp", "fp", "tn", "fn"]

# Leading columns of a prediction table, in output order.
PREDICTION_COLUMNS = [
    "row_index", "group_id", "split", "true_label", "true_class", "predicted_label",
    "predicted_class", "prob_phishing", "prob_legitimate", "correct", "outcome",
]

# Names of the evaluations in the summary.
EVAL_TEST = "test_holdout"
EVAL_OOF = "train_cv_out_of_fold"
EVAL_FOLD_PREFIX = "cv_fold_"
EVAL_MEAN = "cv_mean"
EVAL_STD = "cv_std"

# Forest used while selecting features.
SELECTION_FOREST = {
    "numTrees": 300, "maxDepth": 10, "subsamplingRate": 0.8, "bootstrap": False,
    "featureSubsetStrategy": "0.6", "seed": SEED,
}

# Search space of the final forest (a range excludes its end; None = unlimited / off).
SEARCH_SPACE = {
    "n_estimators": range(200, 1000),
    "max_depth": [None, 8, 12, 16, 24],
    "min_samples_leaf": range(1, 10),
    "min_samples_split": range(2, 20),
    "max_features": ["sqrt", "log2", 0.5, 0.75, None],
    "class_weight": [None, "balanced"],
    "criterion": ["gini", "entropy"],
}
SEARCH_DRAWS = 40
