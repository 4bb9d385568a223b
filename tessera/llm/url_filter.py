"""URL filter: logistic regression on hashed character n-grams, under host rules."""

from __future__ import annotations

import csv
import re
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, batched, table

SIZES = (3, 4, 5)
FEATURES = 1 << 16
ROUNDS = 400
L2 = 1e-3
#: A labelled table is small: training refuses more rows than this.
MAX_LABELLED = 100_000

#: Rules (action, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: The labelled table that the query trains on: ``url, unwanted``.
LABELS = Path(__file__).with_name("url_labels.csv")


def labelled_urls(path: Path = LABELS) -> list[tuple[str, int]]:
    """A labelled table, read where the model is trained; at most MAX_LABELLED rows."""
    with path.open(newline="", encoding="utf-8") as f:
        return [(r["url"], int(r["unwanted"])) for r in csv.DictReader(f)]


def url_host(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host + path``, and its action; null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, action = F.when(fits, name + start).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def ngram_features(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, each kind apart."""
    grams = {f"{kind}{whole[i : i + n]}" for kind, whole in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in SIZES for i in range(len(whole) - n + 1)}
    return np.array(sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % FEATURES for g in grams}), np.int64)


def train(urls: Sequence[tuple[str, str]], labels: Sequence[int]) -> np.ndarray:
    """Weights of an L2-regularised logistic regression, the last one the bias; gradient descent, always the same."""
    if len(urls) > MAX_LABELLED:
        raise ValueError(f"{len(urls)} labelled URLs; at most {MAX_LABELLED} are meant to train this model")
    rows = [np.append(ngram_features(*u), FEATURES) for u in urls]
    row, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    scale = 1 / np.sqrt(np.array([len(r) for r in rows]))[row]
    y, w = np.asarray(labels, float), np.zeros(FEATURES + 1)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.bincount(row, w[col] * scale, len(rows))))
        w -= np.bincount(col, (p - y)[row] * scale, FEATURES + 1) / len(rows) * 4 + L2 * w
    return w


def logits(weights: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """Scores of URLs given their features, before the logistic function."""
    sizes = np.array([len(g) for g in grams], np.int64)
    sums = np.bincount(np.repeat(np.arange(len(grams)), sizes), weights[np.concatenate([*grams, np.zeros(0, np.int64)])], len(grams))
    return (sums + weights[FEATURES]) / np.sqrt(sizes + 1)


def split_url(url: str) -> tuple[str, str]:
    """Host and path of one URL, as ``url_host`` and ``url_path`` give them."""
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url)
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def filter_urls(pages: DataFrame, labelled: Sequence[tuple[str, int]], url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Judge URLs: adds ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (an input column of such a name gives way).

    ``labelled`` holds (URL, 1 if unwanted). ``score`` is the model's probability
    that a URL is unwanted; the verdict is the action of the longest rule that
    fits, else block from ``threshold`` on, else allow. A null URL or one
    without ``://`` has an empty host and path, which the model scores like any
    other. Each row is judged alone, so copies agree and an empty table gives an
    empty result; nothing is shuffled.
    """
    weights = train([split_url(u) for u, _ in labelled], [y for _, y in labelled])
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngram_features(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            scores = logits(sent.value, grams)
            scores = 1 / (1 + np.exp(-scores))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    parts = batched(pages).select(F.struct(*[F.col(c) for c in kept]).alias("row"), url_host(url).alias("host"), url_path(url).alias("path"))
    scored = parts.mapInArrow(score, f"row {parts.schema['row'].dataType.simpleString()}, host string, path string, score double")
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(action, F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("row.*", "host", "path", rule.alias("rule"), "score", judged.alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labelled_urls()).drop("url")
