"""BM25 (Okapi) over a stored index of words, and the hybrid of keyword and vector ranks.

An index is a few Parquet tables, each with a generation for every change:

* ``postings`` (term, id, tf, dl), in folders by a hash of the term, so that a search reads those of its terms alone;
* ``terms`` (term, df), in the same folders, where a deletion adds negative numbers; ``lengths`` (id, dl);
* ``tombstones`` (id): the documents that a deletion took from the generations before it;
* ``stats``, a row for each change with what holds after it: the number of documents, words, different terms, and the mean
  of the terms' raw inverse frequencies. Those of a search's own terms are made when it runs.

A change counts once its row of ``stats`` is there, which is written last, at once for all that belongs together: one that
broke off changes nothing, and what it left lies in generations that no row names. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvane.functions.models import tokens_of
from korvane.session import exists, unused

K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
#: Words in one folder of an index, at least FOLDERS of them; words of one file. Both only steer the cost.
FOLDER_WORDS, FOLDERS, FILE_WORDS = 50_000_000, 16, 2_000_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, term, tf). Words are counted within their row, as runs of equal ones in order, so that none is shuffled."""
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.array_sort(tokens_of(F.col(f"`{text_col}`"))).alias("w")).where(F.size("w") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = words.select("id", "w", F.size("w").alias("dl"), begins.alias("begins"))
    counted = F.transform("begins", lambda b, i: F.struct(F.get("w", b).alias("term"), (F.coalesce(F.get("begins", i + 1), F.col("dl")) - b).cast("long").alias("tf")))
    return runs.select("id", "dl", F.inline(counted))


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


@dataclass(frozen=True)
class Index:
    """The tables of an index (see the module), of all generations together, and its one row of stats."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    n: int
    words: int
    n_terms: int
    mean_idf: float | None
    folders: int

    def frequencies(self) -> DataFrame:
        """(term, df, idf) of all terms. A negative idf becomes EPSILON times the mean idf of all terms."""
        raw = raw_idf(F.lit(self.n), F.col("df"))
        return self.terms.select("term", "df", F.when(raw < 0, F.lit(EPSILON) * F.lit(self.mean_idf)).otherwise(raw).alias("idf"))

    def scores(self, query: str) -> DataFrame:
        """(id, bm25) for EVERY document, 0 without a match. A word that the query repeats counts again."""
        weights = Counter(query.lower().split())
        every = self.lengths.select("id")
        if not weights or not self.words:
            return every.withColumn("bm25", F.lit(0.0))
        mine = F.col("term").isin(*weights) & F.col("folder").isin(*{r["f"] for r in folders_of(self.lengths.sparkSession, weights, self.folders)})
        found = {r["term"]: r["df"] for r in self.terms.where(mine).collect()}  # the query's terms
        if not found:
            return every.withColumn("bm25", F.lit(0.0))
        number = lambda x: F.create_map(*[y for w in found for y in (F.lit(w), F.lit(float(x[w])))])[F.col("term")]
        raw = raw_idf(F.lit(float(self.n)), number(found))
        idf = F.when(raw < 0, F.lit(EPSILON * self.mean_idf)).otherwise(raw)
        part = number(weights) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.words / self.n)))
        hits = self.postings.where(mine).groupBy("id").agg(F.sum(part).alias("s"))
        return every.join(hits, "id", "left").select("id", F.round(F.coalesce("s", F.lit(0.0)), DIGITS).alias("bm25"))


def folder_of(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def folders_of(spark: SparkSession, words, folders: int) -> list:
    return spark.createDataFrame([(w,) for w in sorted(words)], "term string").select(folder_of(F.col("term"), folders).alias("f")).collect()


_STATS = "seq int, kind string, generation string, n long, words long, n_terms long, mean_idf double, folders int"
_SCHEMAS = {"postings": "id long, dl int, term string, tf long, folder int", "terms": "term string, df long, folder int", "lengths": "id long, dl int", "tombstones": "id long"}
#: What each kind of change has.
_PARTS = {"add": ("postings", "terms", "lengths"), "base": ("postings", "terms", "lengths"), "delete": ("terms", "tombstones")}


def _changes(spark: SparkSession, path: str) -> list[dict]:
    """The changes that count, in their order, from the last merge on: a row for each."""
    if not exists(spark, f"{path}/stats"):
        return []
    rows = [r.asDict() for r in spark.read.schema(_STATS).parquet(f"{path}/stats").orderBy("seq").collect()]
    last = max((i for i, r in enumerate(rows) if r["kind"] == "base"), default=0)
    return rows[last:]


def _tables(spark: SparkSession, path: str, changes: list[dict]) -> dict[str, DataFrame]:
    """``postings`` and ``lengths`` of the documents that are left, their ``terms``, each once, and ``tombstones``; a generation of empty texts has no folder of terms."""
    out = {}
    for name, schema in _SCHEMAS.items():
        parts = [
            spark.read.schema(schema).parquet(f"{path}/{name}/generation={r['generation']}").withColumn("seq", F.lit(r["seq"])) for r in changes if name in _PARTS[r["kind"]]
        ]
        table = parts[0] if parts else spark.createDataFrame([], schema + ", seq int")
        for part in parts[1:]:
            table = table.unionByName(part)
        out[name] = table
    if sum("terms" in _PARTS[r["kind"]] for r in changes) > 1:  # one generation has each term once
        out["terms"] = out["terms"].groupBy("folder", "term").agg(F.sum("df").alias("df")).where("df > 0")
    if any(r["kind"] == "delete" for r in changes):
        gone = out["tombstones"].select(F.col("id").alias("gone"), F.col("seq").alias("until"))
        for name in ("postings", "lengths"):
            out[name] = out[name].join(gone, (F.col("id") == F.col("gone")) & (F.col("seq") < F.col("until")), "left_anti")
    return out


def _commit(spark: SparkSession, path: str, before: list[dict], made: list[dict]) -> None:
    """The rows of ``stats`` of changes whose generations are written, as one file."""
    rows, changes = [], list(before) if made[0]["kind"] != "base" else []
    seq = before[-1]["seq"] if before else -1
    for change in made:
        seq += 1
        change |= {"seq": seq, "folders": change.get("folders") or before[-1]["folders"]}
        changes.append(change)
        last = rows[-1] if rows else before[-1] if before and change["kind"] != "base" else {"n": 0, "words": 0}
        change |= {"n": last["n"] + change["n"], "words": last["words"] + change["words"]}
        df = _tables(spark, path, changes)["terms"]
        total = df.agg(F.count("*").alias("terms"), F.avg(raw_idf(F.lit(change["n"]), F.col("df"))).alias("mean")).first()
        change |= {"n_terms": total["terms"], "mean_idf": total["mean"]}
        rows.append(change)
    names = [f.split()[0] for f in _STATS.split(", ")]
    spark.createDataFrame([tuple(r[c] for c in names) for r in rows], _STATS).coalesce(1).write.mode("append").parquet(f"{path}/stats")


def _write_postings(posted: DataFrame, path: str, generation: str, folders: int, words: int) -> None:
    """Postings (id, dl, term, tf) and their terms as a generation."""
    spark = posted.sparkSession
    parts = 1 + words // (folders * FILE_WORDS)  # of a folder; a term of all documents needn't be one task's
    posted = posted.withColumn("folder", folder_of(F.col("term"), folders))
    posted.repartition(folders * parts, "folder", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/postings/generation={generation}")
    mine = spark.read.schema(_SCHEMAS["postings"]).parquet(f"{path}/postings/generation={generation}")
    mine.groupBy("folder", "term").agg(F.count("*").alias("df")).repartition("folder", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(1 + parts // 4))).write.partitionBy("folder").parquet(f"{path}/terms/generation={generation}")


def _added(docs: DataFrame, path: str, before: list[dict], id_col: str, text_col: str) -> dict:
    """A generation of new documents."""
    spark, generation = docs.sparkSession, uuid.uuid4().hex
    lengths = f"{path}/lengths/generation={generation}"
    docs.select(F.col(f"`{id_col}`").alias("id"), F.size(tokens_of(F.col(f"`{text_col}`"))).alias("dl")).write.parquet(lengths)
    batch = spark.read.schema(_SCHEMAS["lengths"]).parquet(lengths).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    folders = before[-1]["folders"] if before else max(FOLDERS, batch["words"] // FOLDER_WORDS)
    _write_postings(postings(docs, id_col, text_col), path, generation, folders, batch["words"])
    return {"kind": "add", "generation": generation, "n": batch["n"], "words": batch["words"], "folders": folders}


def _deleted(ids: DataFrame, path: str, before: list[dict]) -> dict:
    """A generation that takes documents (id) from what is there: postings are read once, for the terms that they had."""
    spark, generation = ids.sparkSession, uuid.uuid4().hex
    tables = _tables(spark, path, before)
    tombstones = f"{path}/tombstones/generation={generation}"
    tables["lengths"].join(ids.select("id").distinct(), "id", "left_semi").select("id", "dl").write.parquet(f"{path}/dead/generation={generation}")
    dead = spark.read.schema(_SCHEMAS["lengths"]).parquet(f"{path}/dead/generation={generation}")
    dead.select("id").distinct().write.parquet(tombstones)
    gone = spark.read.schema("id long").parquet(tombstones)
    less = tables["postings"].join(gone, "id", "left_semi").groupBy("folder", "term").agg((-F.count("*")).alias("df"))
    less.repartition("folder").write.partitionBy("folder").parquet(f"{path}/terms/generation={generation}")
    lost = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    return {"kind": "delete", "generation": generation, "n": -lost["n"], "words": -lost["words"]}


def add_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", replace: bool = False) -> None:
    """Add documents to the index at ``path``, which is made if it isn't there.

    Ids that come twice are an error, as are those that the index has, unless the new documents replace those. Of what is
    stored, lengths are read for the ids, the terms for the new mean, and postings only if documents are replaced.
    """
    spark = docs.sparkSession
    before = _changes(spark, path)
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    twice = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"ids come twice: {', '.join(str(r['id']) for r in twice)}")
    known = _tables(spark, path, before)["lengths"].join(ids, "id", "left_semi").select("id") if before else None
    found = known.limit(3).collect() if known is not None else []
    if found and not replace:
        raise ValueError(f"the index has these ids: {', '.join(str(r['id']) for r in found)}")
    made = [_deleted(known, path, before)] if found else []
    _commit(spark, path, before, [*made, _added(docs, path, before, id_col, text_col)])


def delete_documents(ids: DataFrame, path: str) -> None:
    """Take documents (id) from the index; ids that it doesn't have are passed over."""
    before = _changes(ids.sparkSession, path)
    if not before:
        raise FileNotFoundError(f"{path} is no index")
    _commit(ids.sparkSession, path, before, [_deleted(ids, path, before)])


def merge_generations(spark: SparkSession, path: str) -> None:
    """Write all that is left as one generation, which then stands for all before it. Their folders stay until ``drop_unused``."""
    before = _changes(spark, path)
    if not before:
        raise FileNotFoundError(f"{path} is no index")
    tables, generation = _tables(spark, path, before), uuid.uuid4().hex
    last = before[-1]
    folders = max(FOLDERS, last["words"] // FOLDER_WORDS)
    tables["lengths"].select("id", "dl").write.parquet(f"{path}/lengths/generation={generation}")
    _write_postings(tables["postings"].select("id", "dl", "term", "tf"), path, generation, folders, last["words"])
    _commit(spark, path, before, [{"kind": "base", "generation": generation, "n": last["n"], "words": last["words"], "folders": folders}])


def drop_unused(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of generations that no change names any more: merged ones, and those of changes that broke off.

    No search may be reading what was there before, and no change be under way.
    """
    named = {r["generation"] for r in _changes(spark, path)}
    jvm = spark._jvm
    dropped = []
    for name in (*_SCHEMAS, "dead"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in store.listStatus(folder) if store.exists(folder) else []:
            if status.getPath().getName().removeprefix("generation=") not in named:
                store.delete(status.getPath(), True)
                dropped.append(f"{name}/{status.getPath().getName()}")
    return dropped


def read_index(spark: SparkSession, path: str) -> Index:
    changes = _changes(spark, path)
    if not changes:
        raise FileNotFoundError(f"{path} is no index")
    last, tables = changes[-1], _tables(spark, path, changes)
    del tables["tombstones"]
    return Index(**tables, n=last["n"], words=last["words"], n_terms=last["n_terms"], mean_idf=last["mean_idf"], folders=last["folders"])


def hybrid_stats(index: Index, alpha: float) -> DataFrame:
    """One row: documents, their mean length, distinct words, and the weight in use."""
    row = (index.n, round(index.words / index.n, DIGITS) if index.n else 0.0, index.n_terms, float(alpha))
    return index.lengths.sparkSession.createDataFrame([row], "n_documents long, mean_words double, n_terms long, alpha double")


def min_max(scores: DataFrame, column: str, out: str) -> DataFrame:
    """Scores scaled to 0 to 1 by the smallest and largest of all; 0.5 where all are equal."""
    lo, hi = unused(scores, "_lo"), unused(scores, "_hi")
    ends = scores.agg(F.min(column).alias(lo), F.max(column).alias(hi))  # one row
    scaled = F.when(F.col(hi) == F.col(lo), 0.5).otherwise(F.try_divide(F.col(column) - F.col(lo), F.col(hi) - F.col(lo)))
    return scores.join(F.broadcast(ends)).withColumn(out, F.when(F.col(column).isNotNull(), scaled)).drop(lo, hi)


def reciprocal_ranks(found: DataFrame, score_col: str, id_col: str = "id") -> DataFrame:
    """(id, vec): 1 / rank of the k rows of a top-k result, rank from 1."""
    order = Window.orderBy(F.desc_nulls_last(score_col), id_col)  # k rows
    return found.select(F.col(id_col).alias("id"), (1.0 / F.row_number().over(order)).alias("vec"))


def fuse(vector: DataFrame, keyword: DataFrame, alpha: float) -> DataFrame:
    """(id, score): alpha of the scaled vector score and the rest of the scaled keyword score, over the union of ids."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    v = min_max(vector, "vec", "v").select("id", "v")
    k = min_max(keyword, "bm25", "k").select("id", "k")
    zero = F.lit(0.0)
    return v.join(k, "id", "full_outer").select("id", F.round(alpha * F.coalesce("v", zero) + (1 - alpha) * F.coalesce("k", zero), DIGITS).alias("score"))


def lift_parents(scored: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """Children of (id, parent_id, score) become their parent, once; a child whose parent is absent stays itself.

    Rows without a parent_id stay, even if a child has already brought them in.
    """
    known = parents.select(F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    lifted = scored.select("id", "parent_id", "score").join(known, "parent_id", "left").withColumn("out", F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("id")))
    key = F.struct(F.col("known").isNotNull(), F.when(F.col("known"), F.col("parent_id").cast("string")).otherwise(F.col("id").cast("string")))
    # the best child of each parent; an aggregate combines before its shuffle, so a parent of many children is no burden
    once = lifted.groupBy(key.alias("key")).agg(F.min_by(F.struct("out", "id", "score"), F.struct(-F.col("score"), "id")).alias("best")).select("best.*")
    return once.orderBy(F.desc("score"), "id").limit(k).select(F.col("out").alias("id"), F.col("id").alias("via"), "score")
