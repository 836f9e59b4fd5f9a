"""Fixed values that results depend on, and the small dictionaries that the registered queries use."""

from __future__ import annotations

# Weights of the sensitivity categories.
CATEGORY_WEIGHTS = {"politics": "1.0", "pornography": "1.0", "violence": "0.8", "gambling": "0.8", "fraud": "0.9"}

# Rules of the first harm layer, as pattern, weight and the group that samples show.
HARM_RULES = {
    "url_link": (r"(?i)https?://[^\s]{4,}", "0.3", 0),
    "phone_cn": (r"1[3-9]\d{9}", "0.5", 0),
    "qq_number": (r"[Qq]{2}[：:\s]*\d{5,11}", "0.3", 0),
    "wechat_id": (r"(微信|v信|薇信|VX|wx|WX)[：:\s]*[a-zA-Z0-9_\-一-鿿]{3,20}", "0.3", 1),
    "bank_card": (r"\d{16,19}", "0.4", 0),
    "spam_words": (r"(加[Qq薇微]|免费领取|点击下载|立即注册|限时优惠|名额有限)", "0.4", 1),
}

# Categories of the second harm layer.
HARM_CATEGORIES = ["porn", "gambling", "fraud", "violence", "spam_marketing"]

# Our own: dictionaries with words of the test corpus, for the registered queries.
DEMO_STOPWORDS = ["de", "la", "der", "und", "le", "el"]
DEMO_SENSITIVE = {"trash": ("fraud", "0.8"), "clown": ("gambling", "0.6"), "idiot": ("violence", "0.9"), "scum": ("violence", "1.0"), "worthless": ("fraud", "0.7"), "moron": ("violence", "0.8"), "pathetic": ("politics", "0.5"), "loser": ("gambling", "0.9"), "stupid": ("politics", "0.6"), "disgusting": ("pornography", "0.7")}
DEMO_HARMFUL = {"trash": ("fraud", "0.7"), "clown": ("gambling", "0.8"), "idiot": ("violence", "0.8"), "scum": ("violence", "0.8"), "worthless": ("fraud", "0.7"), "moron": ("violence", "0.8"), "pathetic": ("spam_marketing", "0.4"), "loser": ("gambling", "0.8"), "stupid": ("spam_marketing", "0.4"), "disgusting": ("porn", "0.8")}
DEMO_LEXICON = {"the": "0.30", "of": "-0.20", "on": "0.60", "it": "-0.45", "is": "0.85", "un": "0.55", "une": "-0.35", "los": "0.70", "ist": "-0.80", "por": "0.40", "worthless": "-0.90", "pathetic": "-0.85", "not": "-1.00", "by": "-1.00"}
DEMO_NEGATIONS = ["not", "by", "kein", "sans"]
DEMO_INTENSIFIERS = {"and": "1.5", "that": "0.5", "for": "2.0", "with": "2.5", "des": "1.8", "para": "0.3"}


def sql_values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list; texts that look like numbers stay texts."""
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)
