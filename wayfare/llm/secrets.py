"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest sees each candidate's length, its character transitions, how much of it a
dictionary of the corpus covers, the words of the path it stands in, and the words beside
it; words are hashed into a few counters. It is trained on labelled findings: a table of
(doc_id, start, label) of any origin (`relabelled`), or findings whose truth is known because they
were planted (`planted`): credentials and look-alikes (numbers, digests, names, stand-ins) are
set among the words of a bounded sample of the corpus's own documents. No finding of the corpus is
labelled by its form, and none is settled without the forest. Values of one form stand on both
sides (a digest after the word commit, a key of the same digits after the word token), so
that form alone does not tell them apart.

Planting takes `sample` documents (lowest hashes of their ids) and PLANTS strings in each; training
takes at most `sample` findings of each label, both documented bounds; the
forest itself is trained by Spark. Dictionary and findings cover all texts: a word is in the
dictionary when all texts together hold it REPORT times, however they are dealt out, and
the dictionary stays a table, joined with the words of the candidates.

Defined cases. Null and empty texts have no candidates; texts of any length are scanned
whole. Candidates never overlap: of two at one place the first rule's stays. Positions are
in characters. Without training findings of both labels every score is 0.5. Repeated rows give
repeated findings. doc_id must be whole numbers (it is cast to
long). An absent path column counts as empty; other columns play no part. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.textwords import CHUNK
from wayfare.scratch import write_table

#: Rules in order; group v is the candidate. Fixed formats are those the issuers publish.
RULES = [
    ("private-key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?P<v>[A-Za-z0-9+/=\s]{16,}?)-----END"),
    ("aws-access-key", r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("github-token", r"(?<![A-Za-z0-9])(?P<v>gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    ("google-key", r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_\-]{35})(?![A-Za-z0-9_\-])"),
    ("slack-token", r"(?<![A-Za-z0-9])(?P<v>xox[baprs]-[A-Za-z0-9\-]{10,})"),
    ("jwt", r"(?<![A-Za-z0-9_\-])(?P<v>eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)"),
    ("assigned", r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)\s{0,4}[:=]\s{0,4}[\"']?(?P<v>[^\s\"'&]{6,})"),
    ("long-token", r"(?<![A-Za-z0-9+/_\-])(?P<v>(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}={0,2})(?![A-Za-z0-9+/_\-])"),
]
REPORT = 16  # occurrences in the corpus that make a word of the dictionary
_KINDS = 6  # lower, upper, digit, + / _ -, other, end
COVERED = 2  # place of the dictionary's share in the features
#: Counters for the word just before, the words before it, those after, and those of the path; how many words count on a side.
LAST, BEFORE, AFTER, PATH, BESIDE = 64, 16, 8, 8, 3
WIDTH = 3 + _KINDS * _KINDS + LAST + BEFORE + AFTER + PATH


#: Strings planted in a document of the training sample.
PLANTS = 6
_HEX, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _plant(rng: random.Random, words: list[str]) -> tuple[str, str, str, int]:
    """(before, value, after, label) of a credential (1) or of a look-alike (0)."""
    some = lambda signs, *n: "".join(rng.choice(signs) for _ in range(rng.randint(*n)))
    word = lambda: rng.choice(words)
    name = rng.choice(["token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "access_key", "auth", "TOKEN", "API_KEY", "PASSWORD"])
    quote = rng.choice(['"', "'", ""])
    assign = f"{name}{rng.choice([' = ', '=', ': '])}{quote}"
    if rng.random() < 0.5:
        kinds = [
            (assign, some(_HEX, 32, 64), quote), (assign, some(_HEX, 40, 40), quote), (assign, some(_HEX.upper(), 40, 40), quote), (assign, some(_ALNUM, 16, 48), quote),
            (assign, some(_ALNUM + "+/", 24, 60) + "==", quote), (assign, some(_ALNUM + "!$%*-_", 9, 16), quote), (f"{rng.choice(['bearer', 'key', 'credential', 'passphrase'])} ", some(_ALNUM, 24, 48), ""),
            ("", rng.choice(["AKIA", "ASIA"]) + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), ""), ("", "ghp_" + some(_ALNUM, 36, 36), ""), ("", "AIza" + some(_ALNUM + "_-", 35, 35), ""),
            ("", "xoxb-" + some("0123456789", 11, 12) + "-" + some(_ALNUM, 24, 24), ""), ("", "eyJ" + some(_ALNUM, 20, 40) + ".eyJ" + some(_ALNUM, 30, 90) + "." + some(_ALNUM + "_-", 43, 43), ""),
        ]
        return (*rng.choice(kinds), 1)
    kinds = [
        ("", some("0123456789", 12, 19), ""), (f"{rng.choice(['card', 'order', 'phone', 'account', 'ref', 'iban'])} ", some("0123456789", 12, 22), ""), (f"{rng.choice(['commit', 'revision', 'sha1', 'checksum', 'parent'])} ", some(_HEX, 40, 40), ""),
        (f"{rng.choice(['md5', 'digest', 'etag'])} ", some(_HEX, 32, 32), ""), (f"{rng.choice(['id', 'uuid', 'request'])} ", "-".join(some(_HEX, n, n) for n in (8, 4, 4, 4, 12)), ""), ("", f"20{some('0123456789', 2, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T{some('0123456789', 6, 6)}", ""),
        ("", "-".join([word(), word(), word(), some("0123456789", 1, 4)]), ""), ("", "/".join(["usr", word(), word(), "lib" + some("0123456789", 2, 2)]), ""), (assign, rng.choice(["changeme", "example", "dummy", "sample", "placeholder", "redacted"]) + some("0123456789", 1, 3), quote),
        (assign, "x" * rng.randint(8, 40), quote), (assign, rng.choice(["YOUR_TOKEN_HERE", "${API_KEY}", "<your-secret>", "os.environ[TOKEN]", "REPLACE_ME_NOW"]), quote), (assign, word() + word(), quote), (f"{name}: ", rng.choice(["required", "optional", "string", "invalid"]), ""),
    ]
    return (*rng.choice(kinds), 0)


def _planting(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path")), strict=True):
                rng, parts = random.Random(f"{seed}:{i}"), (text or "").split(" ")
                words = [w for w in map(str.lower, parts) if w.isascii() and w.isalpha()] or ["plain", "word"]
                made, truth, at = [], [], 0
                spots = sorted(rng.randrange(len(parts) + 1) for _ in range(PLANTS))
                for k, part in enumerate([*parts, None]):
                    for _ in range(spots.count(k)):
                        before, value, after, label = _plant(rng, words)
                        truth.append((at + len(before), label))
                        made.append(before + value + after)
                        at += len(made[-1]) + 1
                    if part is not None:
                        made.append(part)
                        at += len(part) + 1
                rows.append({"doc_id": i, "text": " ".join(made), "path": path, "truth": [{"start": s, "label": y} for s, y in truth]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("path", pa.string()), ("truth", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.int32())])))]))

    return run


def planted(docs: DataFrame, sample: int = 2_000, seed: int = 11, known: DataFrame | None = None, path: str | None = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled findings of strings planted in `sample` documents; what else the texts hold has a null label.

    known: the dictionary of the whole corpus, worked out where it is not given.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), where.alias("path")).filter("doc_id IS NOT NULL")
    least = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(sample).agg(F.max("h").alias("h")).first().h
    few = rows.filter(F.xxhash64("doc_id") <= least).dropDuplicates(["doc_id"]) if least is not None else rows.limit(0)
    made = write_table(few.mapInArrow(_planting(seed), "doc_id long, text string, path string, truth array<struct<start: long, label: int>>"), "planted")
    found = findings(made, "path", known=dictionary(docs, text) if known is None else known)
    return relabelled(found, made.select("doc_id", F.inline("truth")))


_WORD = "[a-z]{3,}|[A-Z][a-z]{2,}"


def _shape(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c in "+/_-=" else 4


def _hashed(words: list[str], buckets: int) -> list[float]:
    out = [0.0] * buckets
    for w in words:
        out[zlib.crc32(w.lower().encode()) % buckets] += 1.0
    return out


def features(value: str, before: str, after: str, path: str) -> list[float]:
    """All features but the one at COVERED, which is 0 until the dictionary is joined."""
    n = len(value)
    shapes = [*map(_shape, value), 5]
    moves = np.zeros((_KINDS, _KINDS))
    np.add.at(moves, (shapes[:-1], shapes[1:]), 1)
    words = re.compile("[^\\W\\d_]+").findall
    return [
        float(n), math.log(n), 0.0, *(moves / n).ravel().tolist(),
        *_hashed(words(before)[-1:], LAST), *_hashed(words(before)[-BESIDE:-1], BEFORE), *_hashed(words(after)[:BESIDE], AFTER), *_hashed(words(path), PATH),
    ]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each piece of about CHUNK bytes; a word may come from many pieces."""
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            found = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, to - at))).flatten().value_counts()
            found = found.filter(pc.match_substring_regex(found.field("values"), "^[a-z]{3,}$"))
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])
            at = to


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): words that stand REPORT times or more in all texts together."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(_count_words, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= REPORT)


_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("rule", T.StringType()), T.StructField("value", T.StringType()), T.StructField("label", T.IntegerType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = [(n, re.compile(p)) for n, p in RULES]
    for batch in batches:
        rows = []
        for i, text, path in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("path").to_pylist(), strict=True):
            text = text.as_py() or ""
            taken: list[tuple[int, int]] = []  # in order, apart from one another
            for name, pattern in rules:
                for m in pattern.finditer(text):
                    a, b = m.span("v")
                    at = bisect.bisect(taken, (a, b))
                    if at and taken[at - 1][1] > a or at < len(taken) and taken[at][0] < b:
                        continue
                    taken.insert(at, (a, b))
                    value = m["v"]
                    rows.append({"doc_id": i, "start": a, "end": b, "rule": name, "value": value, "label": None, "x": features(value, text[max(0, a - 40) : a], text[b : b + 40], path or "")})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()), ("value", pa.string()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))]))


def findings(docs: DataFrame, path: str | None = "source", doc_id: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Candidates with their features; label is null. known: a dictionary, that of docs where it is not given."""
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), where.alias("path"))
    found = write_table(rows.mapInArrow(_find, _FOUND), "candidates")
    # what a value's words cover hangs on the value alone, so each value is looked up once
    word = F.explode(F.regexp_extract_all("value", F.lit(_WORD), F.lit(0)))
    words = found.select("value").distinct().select("value", word.alias("word")).withColumn("word", F.lower("word"))
    covered = words.join(dictionary(docs, text) if known is None else known, "word").groupBy("value").agg(F.sum(F.char_length("word")).alias("covered"))
    share = F.coalesce(F.col("covered"), F.lit(0)) / (F.col("end") - F.col("start"))
    x = F.concat(F.slice("x", 1, COVERED), F.array(share), F.slice("x", COVERED + 2, WIDTH - COVERED - 1))
    return write_table(found.join(covered, "value", "left").withColumn("x", x).select(*_FOUND.names), "findings")


def relabelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found with the labels of another table (doc_id, start, label); null where it has none."""
    given = labels.groupBy("doc_id", "start").agg(F.min("label").cast("int").alias("label"))
    return found.drop("label").join(given, ["doc_id", "start"], "left").select(*_FOUND.names)


def fit(labelled: DataFrame, sample: int = 20_000, trees: int = 40, depth: int = 12, seed: int = 3):
    """A forest from (x, label), or None where one of the labels is missing."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    parts = [labelled.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(sample) for y in (0, 1)]
    rows = write_table(parts[0].union(parts[1]).select(F.col("label").cast("double").alias("label"), "x"), "forest-rows")
    if rows.select("label").distinct().count() < 2:
        return None
    rows = rows.select("label", array_to_vector("x").alias("features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)


def scored(found: DataFrame, model) -> DataFrame:
    """found with `score`, the forest's probability of a secret."""
    if model is None:
        return found.withColumn("score", F.lit(0.5))
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(found.withColumn("features", array_to_vector("x")))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
