"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A window is WINDOW consecutive words of an item (all words of a shorter item). A document can hold a window only if it holds all its
words, so for containment the necessary prefix of a window, its words ordered by rarity, is its rarest word: document words meet windows
on that word alone. A candidate is the place where the window would have to begin; places before the text or too near its end go
(position and length bounds), and the rest are verified word by word over a stretch of the window's own size.

Rules for odd input: null and wordless texts have no words and no windows; a null item_id is an item whose id reads as an empty string;
items with equal ids count once; repeated documents get equal rows; empty tables give no hits or an empty result; other columns are
ignored by decontaminate() and carried unread by clean(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, row_key, small, table, written

WINDOW = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """win (array of words), one row per distinct window, and items that have it: (win, item)."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))))
    return w.withColumn("at", starts).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("win")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, least_items: int = 2) -> DataFrame:
    """docs' doc_id with n_words, n_hit, n_items, items_sha256, contaminated.

    Document text is split three times from the scan (rarity counts, candidates, verification) rather than kept, and shuffled once, for
    the verification. The benchmark's tables are broadcast only when counted small.
    """
    return _marked(docs, items, size, least_items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _marked(docs: DataFrame, items: DataFrame, size: int, least_items: int) -> DataFrame:
    keys = row_key(F.col("doc_id"), F.col("text"))
    pairs = written(windows(items, size).withColumn("wid", F.xxhash64("win")).withColumn("wid2", F.hash("win")), "dc-windows")
    wins = written(pairs.select("wid", "wid2", "win").distinct(), "dc-distinct")
    vocab = written(wins.select(F.explode("win").alias("word")).distinct(), "dc-words")
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).join(small(vocab), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranks = written(vocab.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "dc-rarity")
    rarity = small(ranks)
    # the rarest word of each window and the first place where the window has it
    ranked = wins.select("wid", "wid2", F.size("win").alias("k"), F.posexplode("win").alias("off", "word")).join(rarity, "word")
    prefix = ranked.groupBy("wid", "wid2", "k").agg(F.min(F.struct("n", "word", "off")).alias("m")).select("wid", "wid2", "k", F.col("m.word").alias("word"), F.col("m.off").alias("off"))
    rarest = written(prefix, "dc-prefix")
    prefix = small(rarest)
    at = docs.select(*keys, words(F.col("text")).alias("w")).select("k1", "k2", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    begin = F.col("pos") - F.col("off")
    found = at.join(prefix, "word").where((begin >= 0) & (begin + F.col("k") <= F.col("n"))).select("k1", "k2", begin.alias("s"), "wid", "wid2")
    found = found.join(small(wins), ["wid", "wid2"]).select("k1", "k2", "s", "win", "wid", "wid2")
    per = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "win", "wid", "wid2")).alias("cand"))
    full = docs.select("doc_id", *keys, "text").join(per, ["k1", "k2"], "left").withColumn("w", words(F.col("text")))
    true = F.filter("cand", lambda c: F.slice(F.col("w"), c["s"] + 1, F.size(c["win"])) == c["win"])
    ends = F.array_sort(F.transform(true, lambda c: F.struct(c["s"].alias("s"), (c["s"] + F.size(c["win"])).alias("e"), c["wid"].alias("wid"), c["wid2"].alias("wid2"))))
    checked = written(full.select("doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"), F.coalesce(ends, F.array().cast("array<struct<s:int,e:int,wid:bigint,wid2:int>>")).alias("hits")), "dc-checked")
    tables = [pairs, wins, vocab, ranks, rarest, checked]
    # covered words: fold over the sorted stretches
    start = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("hits", start, lambda a, h: F.struct(F.greatest(a["end"], h["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(h["s"], a["end"]))).cast("long").alias("n")))["n"]
    hit_items = checked.where(F.size("hits") > 0).select("k1", "k2", F.explode(F.array_distinct(F.transform("hits", lambda h: F.struct(h["wid"].alias("wid"), h["wid2"].alias("wid2"))))).alias("h")).select("k1", "k2", "h.wid", "h.wid2")
    named = hit_items.join(small(pairs).select("wid", "wid2", "item"), ["wid", "wid2"]).groupBy("k1", "k2").agg(F.collect_set("item").alias("items"))
    named = named.select("k1", "k2", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"))
    whole = F.exists("hits", lambda h: h["e"] - h["s"] >= size)
    out = checked.select("doc_id", "k1", "k2", "n_words", covered.alias("n_hit"), whole.alias("whole")).join(named, ["k1", "k2"], "left")
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    none = F.sha2(F.lit(""), 256)
    out = out.select("doc_id", "k1", "k2", "n_words", "n_hit", "whole", n_items.alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))
    out.work_tables = tables
    return out


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, least_items: int = 2) -> DataFrame:
    """docs without the rows that hold a whole window of size words of any item, or all of least_items shorter items.

    An item shorter than a window may be an everyday phrase, so one alone does not condemn a text; size words in a row do.
    """
    marked = _marked(docs, items, size, least_items)
    bad = written(marked.where(F.col("contaminated") | F.col("whole")).select("k1", "k2").distinct(), "dc-bad")
    drop(*marked.work_tables)
    k1, k2 = row_key(docs["doc_id"], docs["text"])
    bad = small(bad)
    return docs.join(bad, (k1 == bad["k1"]) & (k2 == bad["k2"]), "left_anti")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def decontam_joined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of two neighbouring items each, so that every one is contaminated by two at least."""
    items = table(spark, sf_dir, "benchmark")
    after = items.select((F.col("item_id") - 1).alias("doc_id"), F.col("text").alias("rest"))
    docs = items.withColumnRenamed("item_id", "doc_id").join(after, "doc_id").select("doc_id", F.concat_ws(" ", "text", "rest").alias("text"))
    return decontaminate(docs, items)


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw
), grams AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM pos, ks WHERE i + k - 1 <= len(w)
), hits AS (SELECT doc_id, i, grams.k, item_id FROM grams JOIN win ON grams.k = win.k AND grams.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hits GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
JOINED = "(SELECT a.item_id AS doc_id, a.text || ' ' || b.text AS text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"
ORACLES = {"op5_decontam": ORACLE_SQL, "decontam_joined_items": ORACLE_SQL.replace("FROM documents", f"FROM {JOINED}")}
