"""Exact duplicates by deterministic block naming.

A text without its blanks is cut into blocks of a fixed size. Equal blocks, sorted beside one another, get one integer name; then adjacent names of a
document are paired, equal pairs get one name, and so on until every document has a single one. After as many rounds, two documents have the same name
if, and only if, their texts are equal: no step compares hashes, so no collision can join two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
TASK_BITS = 40  # a block's number: its task's, then its own within the task

BLOCKS = pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("n_blocks", pa.int32()), ("first", pa.int64()), ("block", pa.binary()), ("doc_id", pa.int64()), ("chars", pa.int64()), ("text_sha256", pa.string())])


@dataclass(frozen=True)
class DedupConfig:
    """Bytes of a block; bytes that a task hands on at once; bytes of blocks that a task remembers so as to send each only once.

    A block that was forgotten is sent again: that costs bytes and changes no result.
    """

    block_bytes: int = 16 << 10
    batch_bytes: int = 4 << 20
    remembered_bytes: int = 64 << 20


def blocks_of(docs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """One row for each block of each row of docs: its document's number, its place and the number of the task's first block that equals it; only that one carries bytes.

    A block's number is `row + pos`, unique over all tasks. The block at place 0 also carries doc_id, the code points of the whole text and the sha256
    of the text without blanks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << TASK_BITS
        seen: dict[bytes, int] = {}
        rows, held, kept = [], 0, 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCKS, strict=True)], schema=BLOCKS)
        for batch in batches:
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                cell = batch.column(1)[k]
                raw = cell.as_buffer().to_pybytes() if cell.is_valid else b""
                text = raw.translate(None, BLANKS)
                n, row = max(1, -(-len(text) // config.block_bytes)), number
                about = (doc_id, len(raw.decode("utf-8", "replace")), hashlib.sha256(text).hexdigest())
                for pos in range(n):
                    block = text[pos * config.block_bytes : (pos + 1) * config.block_bytes]
                    first = seen.get(block)
                    rows.append((row, pos, n, number if first is None else first, block if first is None else None, *(about if pos == 0 else (None,) * 3)))
                    held += 100
                    if first is None:
                        if kept > config.remembered_bytes:
                            seen.clear()
                            kept = 0
                        seen[block] = number
                        kept += len(block) + 100
                        held += len(block)
                    number += 1
                    if held >= config.batch_bytes:
                        yield packed()
                        rows, held = [], 0
        if rows:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "row long, pos int, n_blocks int, first long, block binary, doc_id long, chars long, text_sha256 string")


def names_of_blocks(blocks: DataFrame) -> DataFrame:
    """(first, name): blocks sorted by their bytes; the name of a run of equal ones is its least number. A block comes once from a task, so runs are short however often it is repeated."""
    sent = blocks.filter("block is not null").select("first", "block")
    return sent.select("first", F.min("first").over(Window.partitionBy("block")).alias("name"))


def pair_up(named: DataFrame) -> DataFrame:
    """(row, pos, left, right) of adjacent names (row, pos, name) at places 2k and 2k + 1; a last one without a neighbour has -1 at its right."""
    half = F.shiftright("pos", 1)
    side = lambda bit: F.max(F.when(F.col("pos") % 2 == bit, F.col("name")))
    return named.groupBy("row", half.alias("pos")).agg(side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))


def named_documents(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, depth, name) of every document of a stored table of blocks: equal where, and only where, the texts are.

    depth is the number of rounds in which the document's names were paired. Each round works on half the names of the one before and ends when no document
    has more than one; tables of a round are written, so a lost executor repeats a task and not a round.
    """
    names = scratch.table(names_of_blocks(blocks), "names")
    places = blocks.select("row", "pos", "n_blocks", "first").join(names, "first").select("row", "pos", "n_blocks", "name")
    done = [places.filter("n_blocks = 1").select("row", F.lit(0).alias("depth"), "name")]
    left = scratch.table(places.filter("n_blocks > 1").select("row", "pos", "name"), "places")
    for depth in range(1, 64):
        if left.isEmpty():
            break
        pairs = scratch.table(pair_up(left), "pairs")
        # a pair's name is the least number at which it stands, counted before the shuffle; pairs of copies then meet one row each
        least = scratch.table(pairs.groupBy("left", "right").agg(F.min(F.col("row") + F.col("pos")).alias("name")), "names")
        named = scratch.table(pairs.join(least, ["left", "right"]).select("row", "pos", "name"), "places")
        many = named.filter("pos > 0").select("row").distinct()
        done.append(named.join(many, "row", "left_anti").select("row", F.lit(depth).alias("depth"), "name"))
        left = scratch.table(named.join(many, "row", "left_semi"), "places")
    return reduce(DataFrame.unionByName, done)


def exact_duplicates(docs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, depth, name: one row for each row of docs, with the row of its group that stays.

    Texts are equal when identical without blanks (space, tab to carriage return). The row with the most code points in its whole text stays, of equal ones
    that with the least doc_id (null last), of repeated rows one. A null text counts as empty; texts without anything but blanks form one group. Texts of
    any length are read whole. An empty table gives no rows; other columns of docs are not read.

    Scale: one exchange of texts, in which a block comes once from a task; after that only numbers move. Groups are summed before they are shuffled, and
    a group of any size is joined to its one row by an ordinary join that adaptive execution may split.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    blocks = scratch.table(blocks_of(docs, config), "blocks")
    about = blocks.filter("pos = 0").select("row", "doc_id", "chars", "text_sha256")
    each = scratch.table(about.join(named_documents(blocks, scratch), "row"), "documents")
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = scratch.table(each.groupBy("depth", "name").agg(F.count("*").alias("group_size"), best.alias("best")).select("depth", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return each.join(groups, ["depth", "name"]).select("doc_id", "keep_id", "group_size", kept, "text_sha256", "depth", "name")


def without_copies(docs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """The rows of docs, whole, of which exact_duplicates keeps one for each text. Needs doc_id to be unique and not null where rows are to be told apart:
    rows that repeat a kept doc_id stay with it."""
    stay = exact_duplicates(docs, config).filter("kept").select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
