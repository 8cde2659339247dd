"""Small tables with awkward rows, and plain versions of the operators' definitions."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key long, n_words string, spans string, score string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def solid(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed=1, n=40):
    """Prose with copies, near copies, shared passages, repeated lines, odd characters, null, empty and long texts."""
    r = random.Random(seed)
    words = ["the", "of", "über", "naïve", "日本", "data", "Spark", "x1", "and", "to"] + ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]

    def prose(k):
        return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(k))

    passage = prose(60)
    out = [prose(r.randint(5, 150)) for _ in range(n)]
    out += out[:4] + out[:2]
    for t in out[4:10]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [prose(30) + "\n" + passage + "\n" + prose(30) for _ in range(5)]
    out += [None, "", " ", "\n\n", "a", "A b", "one two three four", "one two three four", passage, "aaaa" * 200, "ab" * 300, "same line of text, long enough to count\n" * 6, "▁ \x00 tab\tend \u2028 𝄞 é", prose(4000)]
    return out


def docs(spark, rows=None, extra=True):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", len(t or ""), 7, 8, "clash", "clash", "clash") for i, t in enumerate(rows)]
    if extra:
        data += [data[0], data[5], data[5], (None, "a text without an id, of some words", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
