"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier gives each document's evidence. Hosts and their paths have good-document rates with beta priors: a host's rate shrinks towards the global one, a path's towards its host's,
and how strongly is estimated from the spread of the rates themselves by the method of moments. A document's posterior odds are its classifier evidence times the odds of its path, from
which its own contribution has been taken out. Rates come from grouped aggregates over all documents.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, values, with_row_key, without

#: Labelled rows that the classifier is fitted on at most, those with the smallest hash of their id.
LABELLED = 20_000
#: Documents with a posterior of at least this are kept; site rates stay within these bounds, so that no site alone decides.
THRESHOLD, RATES = 0.5, (0.05, 0.95)
#: Site rates are repeated under so many salts.
SALTS = 32
#: Bounds of the prior strengths, in documents.
STRENGTH = (2.0, 1000.0)

_WORD = re.compile(rb"\S")


def features(text: str) -> list[float]:
    """Statistics of a whole text; zeros without words."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    lines = [x for x in text.encode().split(b"\n") if _WORD.search(x)]
    count = text.count
    symbols = sum(map(count, "#*$%&|<>")) / n
    shouting, marks, digits = sum(map(bytes.isupper, words)) / n, count("!") / n, sum(map(count, "0123456789")) / n
    repeats = sum(map(eq, words, words[1:])) / n
    copied = 1 - len(set(lines)) / len(lines)
    kinds = len(set(words)) / n
    length = sum(map(len, words)) / n
    grow = lambda x: min(1.0, 10 * x)
    return [
        np.log(n), float(n < 20), grow(symbols), symbols, grow(shouting), shouting, grow(marks), grow(digits), grow(repeats), repeats,
        grow(copied), kinds, np.log(length), (count(".") + count(",")) / n, float(words[-1][-1:] in (b".", b"!", b"?")), np.log(max(map(len, words))),
    ]


N_FEATURES = 16


def _measured(docs: DataFrame) -> DataFrame:
    """docs (own, doc_id, host, path, text) with the texts' features in place of the texts."""

    def run(batches):
        for b in batches:
            x = pa.array([features(t or "") for t in values(b.column(4))], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], x], ["own", "doc_id", "host", "path", "x"])

    return docs.mapInArrow(run, f"own {docs.schema['own'].dataType.simpleString()}, doc_id long, host string, path string, x array<float>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float, float]:
    """Weights, offset and prior log odds: Newton steps with a ridge, in standardised features that are folded back into the weights."""
    n, k = x.shape
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(n)])
    w = np.zeros(k + 1)
    w[-1] = prior
    penalty = np.array([ridge] * k + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * (w - np.r_[np.zeros(k), prior]))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean), prior


def _strength(mean: float, spread: float, noise: float) -> float:
    """Documents that a beta prior is worth, whose rates spread by that variance beyond the sampling noise."""
    between = max(spread - noise, 1e-6)
    return float(np.clip(mean * (1 - mean) / between - 1, *STRENGTH))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """One row per document: doc_id, evidence (log odds of the classifier against its prior), host_rate, path_rate, posterior, kept.

    host and path: columns of docs (default: source, and source with lang). Null hosts and paths are sites of their own. labels: doc_id and a quality of 0 or 1; null labels are left out, and of an
    id's several labels the smallest counts. Without labels of both kinds the evidence is 0 and all documents are kept. Null and empty texts have zero features. Repeated rows each give
    a row; an empty table gives none. Scores are kept in whole millionths, so that no rate depends on the order of rows.
    """
    return _judged(docs, labels, F.col(id_col).alias("doc_id"), host, path, id_col, text_col, label_col, labelled).select("own.*", "evidence", "host_rate", "path_rate", "posterior", "kept")


def _judged(docs: DataFrame, labels: DataFrame, own: Column, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """site_quality's columns of each row, with a struct of the given column, own, in place of the id."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    site = lambda *c: F.to_json(F.array(*(x.cast("string") for x in c)), {"ignoreNullFields": "false"})
    rows = cut(_measured(docs.select(F.struct(own).alias("own"), F.col(id_col).cast("long").alias("doc_id"), site(host).alias("host"), site(host, path).alias("path"), F.col(text_col).alias("text"))))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    order = [F.shiftrightunsigned(F.xxhash64("doc_id"), 40), F.col("doc_id")]
    share = min(1.0, (1.1 * labelled + 1000) / max(1, known.count()))  # of the hashes below 2**24 that can be among the smallest
    first = known.filter(order[0] < int(share * (1 << 24)) + 1).orderBy(*order).limit(labelled)
    sample = first.join(rows.select("doc_id", "x", "own"), "doc_id").orderBy(*order, "own").limit(labelled).collect()
    x, y = np.array([r["x"] for r in sample], dtype=np.float64).reshape(-1, N_FEATURES), np.array([r["y"] for r in sample])
    if len(set(y.tolist())) < 2:
        weights, offset, prior = np.zeros(N_FEATURES), 0.0, 0.0
        base = 0.5 + 1e-9
    else:
        weights, offset, prior = fit_logistic(x, y)
        base = None
    logit = F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights.tolist())), lambda a, b: a * b), F.lit(offset), lambda s, v: s + v)
    bounded = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), logit))
    whole = lambda c: F.round(c * 1_000_000).cast("long")
    scored = cut(rows.select("own", "host", "path", (whole(bounded - prior) / 1_000_000).alias("evidence"), whole(1 / (1 + F.exp(-bounded))).alias("p")))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")))
    paths = cut(paths)
    total = hosts.agg(F.sum("hn").alias("n"), (F.sum("hs") / 1_000_000).alias("s"), F.count("*").alias("k")).first()
    million = lambda df, *c: df.withColumns({x: F.col(x) / 1_000_000 for x in c})
    hosts, paths, scored = million(hosts, "hs"), million(paths, "s"), million(scored, "p")
    if not total["n"]:
        return scored.select("own", "evidence", *(F.lit(0.5).alias(c) for c in ("host_rate", "path_rate", "posterior")), F.lit(True).alias("kept"))
    mean = base or total["s"] / total["n"]
    rate = F.col("hs") / F.col("hn")
    spread = hosts.agg(F.sum(F.col("hn") * F.pow(rate - mean, 2)) / F.sum("hn")).first()[0]
    k1 = _strength(mean, spread, mean * (1 - mean) * total["k"] / total["n"])
    named = paths.join(hosts, "host")
    within = named.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - rate, 2)) / F.sum("n"), F.count("*")).first()
    k2 = _strength(mean, within[0], mean * (1 - mean) * within[1] / total["n"])
    sites = cut(named.select("path", "n", "s", "hn", "hs").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("own", "evidence"), F.lit(SALTS)).cast("int"))  # a site with a third of all rows joins in many tasks
    lone = lambda s, n, to, k: (k * to + F.col(s) - F.col("p")) / (k + F.col(n) - 1)  # noqa: E731  without the document itself
    clip = lambda c: F.greatest(F.lit(RATES[0]), F.least(F.lit(RATES[1]), c))
    out = salted.join(sites, ["path", "salt"]).withColumn("host_rate", clip(lone("hs", "hn", F.lit(mean), k1))).withColumn("path_rate", clip(lone("s", "n", F.col("host_rate"), k2)))
    odds = F.col("evidence") + _logit(F.col("path_rate"))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select("own", "evidence", "host_rate", "path_rate", "posterior", (F.lit(base is not None) | (F.col("posterior") >= THRESHOLD)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that site_quality rejects; columns as they came. Each row is judged by itself, whatever its id."""
    keyed, name = with_row_key(docs)
    return without(keyed, name, _judged(keyed, labels, F.col(name)).filter("not kept").select("own.*"))
