"""A small table of awkward documents, and plain versions of the operators."""

import collections
import hashlib
import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def rows():
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghilmnorstuäé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = text(220), text(60)
    words = base.split()
    out = [base, base, base.upper(), " ".join(words[:100] + ["x"] + words[100:]), " ".join(words[:190]), " ".join(words[:150] + text(70).split())]
    out += [text(20) + " " + passage + " " + text(30) for _ in range(4)]
    out += [passage + " " + passage, text(34), passage[:80], "", " \n\t ", None, "one", "a b c d", "a b c d e", "A b c d e", "\x00 \x1c z", text(3000)]
    out += ["mail bob@example.org or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "Released under the MIT License.", "idiot " * 9, "### $$$ %%% " * 30]
    out += [text(r.randint(1, 80)) for _ in range(40)]
    made = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(out)]
    return made + [made[0], made[8], (None, base + " tail", "en", "s0", 5), (None, None, None, None, None)]


def documents(spark, extra=False):
    df = spark.createDataFrame(rows(), SCHEMA)
    if extra:
        df = df.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'x' as n_words", "1 as label", "'y' as TEXT", "2 as hash")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
