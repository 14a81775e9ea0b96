"""Language of web pages: evidence of text, declared markup, address suffix and host, fused by Bayes' rule."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import LOWER, mix, slices, table, text_bytes, tidy
from themeloom.session import cut_lineage

BUCKETS = 1 << 14
"""Hashed runs of three bytes that a language has a probability of."""
LANGUAGES = 256
"""Languages at most, so that the model is 16 MB at most."""
EVIDENCE = 50.0
"""Runs of bytes that a text counts as at most: neighbouring runs are no independent evidence."""
HOST_WEIGHT, DOMAIN_WEIGHT, SMOOTH = 5.0, 20.0, 1.0
"""Pages that the prior of the level above counts as, for a host and for a domain; and what is added to each count."""
TRUST = 4.0
"""Pages that a declared language or an address suffix named like a language counts as for that language."""
U = np.uint64
HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)", re.I | re.S)
TAG = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})\b", re.I)
DECLARED_META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})\b", re.I)


def runs_of_three(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of three bytes of each text, lower-cased, and the texts they are in."""
    if len(blob) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[blob].astype(np.uint32)
    low[low < 97] = 32  # digits, signs and white space say little
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (text[:-2] == text[2:]) & (low[1:-1] != 32)
    return (mix(code[inside].astype(U)) % U(BUCKETS)).astype(np.int64), text[:-2][inside]


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of runs of bytes in each, counted over all of ``docs`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part, blob, offsets in slices(batches):
            run, text = runs_of_three(blob, offsets)
            names, which = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for n, name in enumerate(names):
                totals[name] = totals.get(name, 0) + np.bincount(run[which[text] == n], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array([t.astype(np.int64).tobytes() for t in totals.values()], pa.binary())], ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, some in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist()):
                totals[lang] = totals.get(lang, 0) + np.frombuffer(some, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["lang", "counts"])

    named = docs.where(F.col("lang").isNotNull() & (F.trim("lang") != "")).select(F.lower(F.trim("lang")).alias("lang"), text_bytes().alias("text"))
    schema = "lang string, counts binary"
    rows = sorted(named.mapInArrow(tidy(count), schema).repartition("lang").mapInArrow(tidy(add), schema).collect())
    if len(rows) > LANGUAGES:
        raise ValueError(f"{len(rows)} languages are more than {LANGUAGES}")
    if not rows:
        return [], np.zeros((0, BUCKETS), np.float32)
    counts = np.array([np.frombuffer(row.counts, np.int64) for row in rows]) + 0.5
    return [row.lang for row in rows], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def address(url: str | None) -> tuple[str, str, str]:
    """Host, its last two labels, and its last label; empty where there is none."""
    try:
        host = (urlsplit(url or "").hostname or "").lower().rstrip(".")
    except ValueError:
        host = ""
    labels = [label for label in host.split(".") if label]
    return host, ".".join(labels[-2:]), labels[-1] if labels else ""


def declared(page: str) -> str:
    found = DECLARED.search(page) or DECLARED_META.search(page)
    return found[1].lower() if found else ""


def page_evidence(pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, text (log likelihoods by language, of at most EVIDENCE runs) and best (-1: no text)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, blob, offsets in slices(batches, "html"):
            raw = [x.decode("utf-8", "replace") for x in part.column("html").to_pylist()]
            texts = [entities.unescape(TAG.sub(" ", HIDDEN.sub(" ", page))).encode() for page in raw]
            found, text = runs_of_three(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))))
            number = np.bincount(text, minlength=len(texts))
            logs = np.array([np.bincount(text, weights=row[found], minlength=len(texts)) for row in model], float).reshape(len(model), -1).T
            logs *= np.minimum(1.0, EVIDENCE / np.maximum(number, 1))[:, None]
            best = np.where(number > 0, logs.argmax(axis=1), -1) if len(model) else np.full(len(texts), -1)
            hosts, domains, suffixes = zip(*map(address, part.column("url").to_pylist()))
            yield pa.RecordBatch.from_arrays([
                part.column("page_id"), pa.array(hosts), pa.array(domains), pa.array(suffixes), pa.array([declared(page) for page in raw]),
                pa.array(logs.tolist(), pa.list_(pa.float64())), pa.array(best.astype(np.int32)),
            ], ["page_id", "host", "domain", "suffix", "declared", "text", "best"])

    schema = "page_id long, host string, domain string, suffix string, declared string, text array<double>, best int"
    return pages.select("page_id", "url", text_bytes("html").alias("html")).mapInArrow(tidy(run), schema)


def _votes(rows: DataFrame, *keys: str) -> DataFrame:
    """For each value of ``keys`` the number of pages by language of their text, as a map with at most one entry a language."""
    counts = rows.where("best >= 0").groupBy(*keys, "best").count()
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "count"))).alias("votes"), F.sum("count").alias("pages"))


def identify(pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """page_id, lang, probability of every page of (page_id, url, html), and the evidence: text_lang, declared, suffix, host.

    The posterior is proportional to the likelihood of the page's text, to how often pages whose text is in that language
    declare this page's language and have its address suffix, and to the host's prior. That is the share of languages
    among the host's other pages, smoothed towards that of its domain (last two labels), which is smoothed towards that of
    all pages. Evidence that is missing (null or empty html, no declaration, a url without a host) says nothing; a page
    without any gets the most frequent language. Ties go to the first language in order. Without languages, lang is null.
    Rows may repeat, other columns are not looked at, an empty table gives an empty table.
    """
    number = len(languages)
    if not number:
        return pages.select("page_id", *[F.lit(None).cast(kind).alias(c) for c, kind in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string"))])
    rows = cut_lineage(page_evidence(pages, languages, model))
    of = lambda votes, n: F.coalesce(F.element_at(votes, F.lit(n)), F.lit(0)).cast("double")
    total = _votes(rows).first()
    votes, voters = (total.votes or {}, total.pages or 0) if total else ({}, 0)
    everywhere = [(votes.get(n, 0) + SMOOTH) / (voters + SMOOTH * number) for n in range(number)]
    for key in ("declared", "suffix", "domain", "host"):
        seen = _votes(rows.where(F.col(key) != ""), key).select(key, F.col("votes").alias(f"{key}_votes"), F.col("pages").alias(f"{key}_pages"))
        rows = rows.join(seen, key, "left")

    def likelihood(key: str, n: int) -> Column:
        """How often pages of language ``n`` have this value, this page left out: by Bayes' rule from the share among its pages."""
        own = F.when(F.col("best") == n, 1.0).otherwise(0.0)
        any_ = F.when(F.col("best") >= 0, 1.0).otherwise(0.0)
        named, any_named = F.when(F.col(key) == languages[n], TRUST).otherwise(0.0), F.when(F.col(key).isin(languages), TRUST).otherwise(0.0)
        share = (of(f"{key}_votes", n) - own + named + SMOOTH * everywhere[n] * number) / (F.coalesce(f"{key}_pages", F.lit(0)) - any_ + any_named + SMOOTH * number)
        return F.when(F.col(key) == "", 0.0).otherwise(F.log(share / everywhere[n]))

    def prior(n: int) -> Column:
        own = F.when(F.col("best") == n, 1.0).otherwise(0.0)
        any_ = F.when(F.col("best") >= 0, 1.0).otherwise(0.0)
        count = lambda key: F.when(F.col(key) == "", 0.0).otherwise(of(f"{key}_votes", n) - own)
        pages_of = lambda key: F.when(F.col(key) == "", 0.0).otherwise(F.coalesce(f"{key}_pages", F.lit(0)) - any_)
        domain = (count("domain") + DOMAIN_WEIGHT * everywhere[n]) / (pages_of("domain") + DOMAIN_WEIGHT)
        return F.log((count("host") + HOST_WEIGHT * domain) / (pages_of("host") + HOST_WEIGHT))

    names = F.array(*[F.lit(x) for x in languages])
    scores = F.array(*[F.col("text")[n] + likelihood("declared", n) + likelihood("suffix", n) + prior(n) for n in range(number)])
    rows = rows.select("page_id", "host", "suffix", "declared", "best", scores.alias("scores")).withColumn("top", F.array_max("scores"))
    sum_ = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return rows.select(
        "page_id", F.get(names, F.array_position("scores", F.col("top")).cast("int") - 1).alias("lang"), F.when(F.col("top").isNotNull(), 1 / sum_).alias("probability"),
        F.when(F.col("best") >= 0, F.get(names, F.col("best"))).alias("text_lang"), "declared", "suffix", "host",
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``pages``; missing evidence says nothing, ties go to the first language in order (see ``identify``)."""
    model = text_model(table(spark, sf_dir, "documents", "lang", "text"))
    return identify(table(spark, sf_dir, "pages", "page_id", "url", "html"), *model)
