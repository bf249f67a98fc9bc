"""A stored inverted index with positions: built in blocks of documents, appended by generation, searched by bucket.

A block holds some hundred documents of like length. All of a block's words lie in one row for each bucket of words:
the words, the documents of each (by their numbers among the block's ids) and counts, and its positions, each
packed in one value. Map tasks make whole blocks, so nothing but these rows is shuffled, and a word that every document holds
is a short piece of every block. Rows are dealt by bucket and slice of blocks; a bucket is a folder, so a search reads
those of its words, once: what it finds of them is kept, and dealt by block, where documents are whole.

Words are runs of letters and digits in lower case; positions count them from 1.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.functions import text as T
from larkmill.operators.retrieval import top_k
from larkmill.session import bound_batches, cut_lineage, small_or_not, spread_rows
from larkmill.sources.commits import CommitLog

TOKEN = r"[\p{L}\p{N}]+"
_TOKEN = re.compile(r"\w+")  # the same characters and the underscore
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
# ``terms`` are joined by blanks. ``starts`` of a word's documents and ``places`` of its positions have one entry more than
# there are words. Numbers are packed in the fewest bytes that hold a row's largest, as Spark copies bytes as they are,
# but lists by their elements. Lengths of the block's documents stand in a bucket of their own, -1, without words.
ROW = "block long, ids array<long>, terms string, starts binary, docs binary, counts binary, places binary, positions binary"


@dataclass(frozen=True)
class IndexRules:
    buckets: int = 64
    block_docs: int = 256  # 32,767 at most
    slice_docs: int = 1 << 20  # documents of which one task writes a bucket
    vocabulary: int = 1 << 18  # spellings beyond which a task begins anew to number them
    pairs: int = 2_000_000  # pairs of a query and a document that one task of a search adds up, about


def tokens(text: Column) -> Column:
    """The words of a text in order."""
    return F.transform(F.regexp_extract_all(T.empty_if_null(text), F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))


def search_terms(text: Column, most: int = 20, stop=T.FTS_STOP_WORDS) -> Column:
    """The first ``most`` different words over two characters that are no stop words."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*stop))), 1, most)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in one, two or four bytes each; the first byte says in how many."""
    most = int(numbers.max(initial=0))
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where those of each row begin, with the end behind them."""
    parts = [np.frombuffer(x, f"<u{x[0]}", offset=1) for x in column.to_pylist()]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), np.cumsum([0, *map(len, parts)])


def words_of(text: str) -> list[str]:
    """The words of a text as they are spelt."""
    return text.encode().translate(_ASCII).decode().split() if text.isascii() else _TOKEN.findall(text.replace("_", " "))


class Vocabulary(dict):
    """The numbers of words, by their spellings; a task keeps them from block to block."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.words, self.own, self.lower = buckets, [], [], {}

    def __missing__(self, spelling: str) -> int:
        word = spelling.lower()
        found = self.lower.setdefault(word, len(self.words))
        if found == len(self.words):
            self.words.append(word)
            self.own.append((zlib.crc32(word.encode()) % self.buckets << 32) + found)
        self[spelling] = found
        return found


def packed_block(block: int, ids: list[int], texts: list[list[str]], vocabulary: Vocabulary) -> pa.RecordBatch:
    """The rows of a block of texts in words, one for each bucket that has words, and one for the documents' lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    spelt = list(chain.from_iterable(texts))
    numbers = np.fromiter(map(vocabulary.__getitem__, spelt), np.int64, len(spelt))
    held = np.flatnonzero(np.bincount(numbers))  # the block's words
    keys = np.sort(np.array(vocabulary.own, np.int64)[held])  # by bucket and number
    by_number, own = keys & 0xFFFFFFFF, keys >> 32
    rank = np.empty(len(vocabulary.words), np.int64)
    rank[by_number] = np.arange(len(keys))
    code = rank[numbers].astype(np.uint16 if len(keys) <= 1 << 16 else np.int64)  # numpy sorts short numbers by their digits
    document = np.repeat(np.arange(len(texts)), sizes)
    position = np.arange(len(code)) - np.repeat(sizes.cumsum() - sizes, sizes) + 1
    order = np.argsort(code, kind="stable")  # by word, then document, then position
    code, document, position = code[order], document[order], position[order]
    fresh = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (document[1:] != document[:-1])]) if len(code) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[fresh, len(code)])
    starts = np.searchsorted(code[fresh], np.arange(len(keys) + 1))  # of each word among its documents
    places = np.searchsorted(code, np.arange(len(keys) + 1))  # of each word among positions
    edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(keys) else np.zeros(0, np.int64)
    high = np.r_[edge[1:], len(keys)].astype(np.int64)[: len(edge)]
    ordered, document = [vocabulary.words[i] for i in by_number.tolist()], document[fresh]
    rows = []
    for a, b in zip(edge.tolist(), high.tolist(), strict=True):
        first, last = starts[a], starts[b]
        rows.append((
            " ".join(ordered[a:b]), pack(starts[a : b + 1] - first), pack(document[first:last]), pack(counts[first:last]),
            pack(places[a : b + 1] - places[a]), pack(position[places[a] : places[b]]),
        ))
    none = pack(np.zeros(0, np.int64))
    rows.append(("", none, pack(np.arange(len(ids))), pack(sizes), none, none))
    terms, *packed = zip(*rows, strict=True)
    all_ids = pa.array(np.tile(np.array(ids, np.int64), len(rows)), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[own[edge], -1], pa.int32()), pa.array(np.full(len(rows), block), pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(ids), pa.int32()), all_ids),
            pa.array(terms, pa.string()), *(pa.array(x, pa.binary()) for x in packed),
        ],
        ["bucket", *(c.split()[0] for c in ROW.split(", "))],
    )


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them, one stretch after the other."""
    return np.arange(size.sum()) + np.repeat(first - (size.cumsum() - size), size)


def found_words(batch: pa.RecordBatch, positions: bool) -> pa.RecordBatch:
    """A row for each of the asked ``words`` that an index row holds: its documents, and the counts or positions in each."""
    listed = pc.split_pattern(batch.column("terms"), " ")
    terms, ends = listed.flatten(), pc.list_value_length(listed).to_numpy(zero_copy_only=False).cumsum()
    at = np.flatnonzero(pc.is_in(terms, pc.unique(batch.column("words").flatten())).to_numpy(zero_copy_only=False))  # a word is in one bucket only
    row = np.searchsorted(ends, at, "right")
    (starts, _), (docs, own_docs), (counts, _) = (unpacked(batch.column(name)) for name in ("starts", "docs", "counts"))
    first = starts[at + row]  # each row has an entry more than words
    size = starts[at + row + 1] - first
    among = ranges(own_docs[row] + first, size)
    own_ids = np.cumsum(np.r_[0, pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)]).astype(np.int64)
    ids = batch.column("ids").flatten().to_numpy()[np.repeat(own_ids[row], size) + docs[among]]
    each = pa.array(counts[among], pa.int32())
    if positions:
        (places, _), (every, own_every) = unpacked(batch.column("places")), unpacked(batch.column("positions"))
        begun = places[at + row]
        where = ranges(own_every[row] + begun, places[at + row + 1] - begun)
        each = pa.ListArray.from_arrays(pa.array(np.r_[0, counts[among].cumsum()], pa.int32()), pa.array(every[where], pa.int32()))
    lists, own = pa.array(np.r_[0, size.cumsum()], pa.int32()), pa.array(row)
    return pa.RecordBatch.from_arrays(
        [batch.column("generation").take(own), batch.column("block").take(own), terms.take(pa.array(at)),
         pa.ListArray.from_arrays(lists, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(lists, each)],
        ["generation", "block", "term", "docs", "each"],
    )


class TextIndex:
    """An index below ``path``; what it consists of is in its log."""

    def __init__(self, spark: SparkSession, path: str, rules: IndexRules = IndexRules()):
        self.spark, self.path, self.log = spark, path, CommitLog(spark, path)
        self.rules = IndexRules(**{**rules.__dict__, **self.log.latest()[1].get("fixed", {})})

    def append(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Adds documents whose ids the index doesn't hold, as one generation. Rows without an id aren't added; of rows
        sharing an id, the one of the least text is."""
        rules, known = self.rules, self.lengths()
        rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), T.empty_if_null(F.col(text)).alias("text"))
        if known is not None:
            rows = rows.join(known.select("doc_id"), "doc_id", "left_anti")
        counted = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("docs"), F.max("n").alias("most")).first()
        if not counted["docs"]:
            return
        if counted["most"] > 1:
            rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
        slices = -(-counted["docs"] // rules.slice_docs)
        bound_batches(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, vocabulary = TaskContext.get().partitionId() << 32, Vocabulary(rules.buckets)
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                words = [words_of(x) for x in texts]
                order = sorted(range(len(ids)), key=lambda i: (len(words[i]), ids[i]))  # like lengths share a block
                for low in range(0, len(order), rules.block_docs):
                    some = order[low : low + rules.block_docs]
                    yield packed_block(number, [ids[i] for i in some], [words[i] for i in some], vocabulary)
                    number += 1
                if len(vocabulary) > rules.vocabulary:
                    vocabulary = Vocabulary(rules.buckets)

        made = spread_rows(rows).mapInArrow(run, f"bucket int, {ROW}")
        name = f"generation-{uuid.uuid4().hex}"
        dealt = made.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(slices))).sortWithinPartitions("bucket", "block")
        dealt.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/{name}")
        fixed = {"buckets": rules.buckets, "block_docs": rules.block_docs}
        self.log.update(lambda state: {"fixed": fixed, "generations": [*state.get("generations", []), name]})

    def rows(self, buckets: list[int]) -> DataFrame | None:
        """The rows of some buckets, with the generation they are of; None while there is none."""
        names = self.log.latest()[1].get("generations", [])
        if not names:
            return None
        found = self.spark.read.schema(f"{ROW}, bucket int").option("basePath", self.path)
        parts = [found.option("basePath", f"{self.path}/{n}").parquet(f"{self.path}/{n}").withColumn("generation", F.lit(n)) for n in names]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.where(F.col("bucket").isin(buckets))

    def lengths(self) -> DataFrame | None:
        """(doc_id, n_words) of all documents."""
        rows = self.rows([-1])
        if rows is None:
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), pa.array(unpacked(batch.column("counts"))[0], pa.int32())], ["doc_id", "n_words"])

        return rows.select("ids", "counts").mapInArrow(run, "doc_id long, n_words int")

    def _wanted(self, queries: DataFrame, query_id: str, terms: Column) -> tuple[DataFrame, DataFrame, list[int]]:
        """(query_id, n_terms, slot, term), the words of each bucket, and the buckets."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(terms).alias("terms"))
        wanted = cut_lineage(
            asked.select("query_id", F.size("terms").cast("long").alias("n_terms"), F.posexplode("terms").alias("slot", "term"))
        )
        bucket = (F.crc32(F.col("term").cast("binary")) % self.rules.buckets).cast("int")
        by_bucket = cut_lineage(wanted.groupBy(bucket.alias("bucket")).agg(F.collect_set("term").alias("words")))
        return wanted, by_bucket, sorted(r["bucket"] for r in by_bucket.select("bucket").collect())

    def _found(self, wanted: DataFrame, by_bucket: DataFrame, rows: DataFrame, positions: bool = False) -> DataFrame:
        """(generation, block, term, docs, each): a row for each asked word of a block, with the counts in its documents,
        or their positions. The index is read once for it."""
        bound_batches(self.spark)
        columns = ["generation", "block", "ids", "terms", "starts", "docs", "counts", *(["places", "positions"] if positions else []), "words"]
        # There are no more rows of ``by_bucket`` than buckets; they hold the words that are asked.
        words = F.broadcast(by_bucket) if wanted.limit(200_001).count() <= 200_000 else by_bucket

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield found_words(batch, positions)

        kind = "array<int>" if positions else "int"
        asked = rows.join(words, "bucket").select(*columns)
        return cut_lineage(asked.mapInArrow(run, f"generation string, block long, term string, docs array<long>, each array<{kind}>"))

    def _asked(self, held: DataFrame, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
        """``held`` with (query_id, n_terms, slot) of the queries that ask for the word, for the (query_id, generation,
        block) of ``pairs``. Words are dealt by block before they meet queries, so that what is grouped by block, query
        and document afterwards needs no shuffle."""
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-pairs.count() * self.rules.block_docs // self.rules.pairs))
        keys = ["generation", "block"]
        opened = pairs.repartition(tasks, *keys).groupBy(*keys).agg(F.collect_set("query_id").alias("opened"))
        met = held.repartition(tasks, *keys).join(opened, keys).join(small_or_not(wanted), "term")
        return met.where(F.array_contains("opened", F.col("query_id")))

    def top_k(self, queries: DataFrame, query_id: str, terms: Column, k: int, mode: str = "any", first_blocks: int = 8) -> DataFrame:
        """(query_id, rank, doc_id, n_terms, n_found, fts_score): the best documents that hold any (or all) terms.

        The score is the mean of tf / (tf + 1) over the terms; of equal ones the smaller id comes first. No document of
        a block scores more than its largest counts would. Each query's most promising blocks are added up first; after
        that, only blocks whose bound reaches the k-th score found so far. The result is that of a scan.
        """
        wanted, by_bucket, buckets = self._wanted(queries, query_id, terms)
        rows = self.rows(buckets)
        if rows is None:
            return self.spark.createDataFrame([], wanted.select("query_id", "n_terms").schema).selectExpr(
                "query_id", "1 AS rank", "1L AS doc_id", "n_terms", "1L AS n_found", "1D AS fts_score"
            )
        held = self._found(wanted, by_bucket, rows)
        most = F.array_max("each")
        heads = held.select("generation", "block", "term", (most / (most + 1)).alias("best")).join(small_or_not(wanted), "term")
        bounds = heads.groupBy("query_id", "n_terms", "generation", "block").agg(F.sum("best").alias("bound"), F.count("*").alias("slots"))
        bounds = cut_lineage(bounds if mode == "any" else bounds.where(F.col("slots") == F.col("n_terms")))
        first = cut_lineage(top_k(bounds, "query_id", first_blocks, F.desc("bound"), F.asc("block"), F.asc("generation")).drop("rank"))
        best = cut_lineage(self._best(self._scored(first, wanted, held, mode), k))
        least = best.where(F.col("rank") == k).select(F.col("query_id").alias("l_query"), "mass")
        # Sums in another order may differ in their last digits.
        open_ones = bounds.join(small_or_not(least), F.col("query_id") == F.col("l_query"), "left").where(
            F.col("mass").isNull() | (F.col("bound") >= F.col("mass") - 1e-9)
        )
        keys = ["query_id", "generation", "block"]
        rest = cut_lineage(open_ones.join(small_or_not(first.select(*keys)), keys, "left_anti").select(*bounds.columns))
        more = self._scored(rest, wanted, held, mode)
        found = self._best(best.drop("rank").unionByName(more), k)
        return found.select("query_id", "rank", "doc_id", "n_terms", "n_found", (F.col("mass") / F.col("n_terms")).alias("fts_score"))

    @staticmethod
    def _best(scored: DataFrame, k: int) -> DataFrame:
        return top_k(scored, "query_id", k, F.desc(F.round("mass", 9)), F.asc("doc_id"))

    def _scored(self, pairs: DataFrame, wanted: DataFrame, held: DataFrame, mode: str) -> DataFrame:
        """(query_id, doc_id, n_terms, mass, n_found) of the documents of (query_id, generation, block)."""
        each = self._asked(held, wanted, pairs).select(
            "generation", "block", "query_id", "n_terms", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("each").alias("tf")))
        )
        scored = each.groupBy("generation", "block", "query_id", "doc_id", "n_terms").agg(
            F.sum(F.col("tf") / (F.col("tf") + 1)).alias("mass"), F.count("*").alias("n_found")
        )
        return (scored if mode == "any" else scored.where(F.col("n_found") == F.col("n_terms"))).drop("generation", "block")

    def matches(self, queries: DataFrame, query_id: str, terms: Column, mode: str = "all") -> DataFrame:
        """(query_id, doc_id, n_terms, n_found, entries) of the documents with all (or any) terms: ``entries`` are the
        places (pos, slot) of the query's terms in order."""
        wanted, by_bucket, buckets = self._wanted(queries, query_id, terms)
        rows = self.rows(buckets)
        if rows is None:
            rows = self.spark.createDataFrame([], f"{ROW}, bucket int, generation string")
        held = self._found(wanted, by_bucket, rows, positions=True)
        pairs = held.select("generation", "block", "term").join(small_or_not(wanted), "term").groupBy("query_id", "generation", "block", "n_terms").agg(F.count("*").alias("slots"))
        if mode == "all":  # blocks that lack a term go before their documents are spelt out
            pairs = pairs.where(F.col("slots") == F.col("n_terms"))
        each = self._asked(held, wanted, cut_lineage(pairs)).select(
            "generation", "block", "query_id", "n_terms", "slot", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("each").alias("places")))
        )
        found = each.groupBy("generation", "block", "query_id", "doc_id", "n_terms").agg(
            F.count("*").alias("n_found"), F.collect_list(F.struct("slot", "places")).alias("own")
        )
        found = found if mode == "any" else found.where(F.col("n_found") == F.col("n_terms"))
        placed = F.transform("own", lambda o: F.transform(o["places"], lambda p: F.struct(p.alias("pos"), o["slot"].alias("slot"))))
        return found.select("query_id", "doc_id", "n_terms", "n_found", F.array_sort(F.flatten(placed)).alias("entries"))
