"""Merkle manifest of a dataset: a digest per row, a tree per group of rows, a tree over the groups.

A leaf's place in its group is the rank of its id. Ranks come from bitmaps, not from sorting: the ids of a group
are the bits of 64-bit words, of which only those with a bit are kept; every task makes words of its rows and
equal words are merged. Up to 16 words make a container, and a directory of counts over containers, and over
blocks of containers, tells how many ids come before each. The rank of an id is that number and the bits
before its own. Rows that share an id are counted in the words and told apart by their digests.

Rank and group give a slot in an array of `SPAN` digests. One task reduces an array to one node, however the rows
came, so a round takes off seven levels of three children each. Going back down, the siblings on the way to the
root are handed from block to block, and the task that holds a block of leaves proves each of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow, read, stored

#: Children of a node. `SPAN` leaves make a block, which is `ROUND` levels of the tree.
ARITY = 3
ROUND = 7
SPAN = ARITY**ROUND

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Ids share a container if they are equal beyond these bits, and a directory block if beyond those further ones.
WORD_BITS, CONTAINER_BITS, DIRECTORY_BITS, DIRECTORY_LEVELS = 6, 4, 18, 3

#: Rows without an id come first: the number of their word is below that of any id.
_NO_ID = -(1 << 63)
#: Equal rows are dealt out in portions of this size.
PORTION = 1 << 16


def framed(value: Column) -> Column:
    """A value as its UTF-8 byte count, `:` and itself; null as `-`."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the framed values, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(framed, values)), 256))


# ---- places by ranks of bitmaps


def _position(id_: Column) -> Column:
    return F.coalesce(id_.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int"), F.lit(0))


def _word(id_: Column) -> Column:
    return F.coalesce(F.shiftright(id_, WORD_BITS), F.lit(_NO_ID))


def bitmap_words(rows: DataFrame) -> DataFrame:
    """(tree, word, bits, n): the ids of every tree, 64 to a word, and the rows of these ids."""
    bit = F.expr("shiftleft(1L, __position)")
    placed = rows.select("tree", _word(F.col("id")).alias("word"), _position(F.col("id")).alias("__position"))
    return placed.groupBy("tree", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def rank_directory(words: DataFrame) -> DataFrame:
    """(tree, word, bits, n, before): before counts the rows of the tree whose words are smaller."""
    listed = F.array_sort(F.collect_list(F.struct("word", "bits", "n")))
    containers = words.groupBy("tree", F.shiftright("word", CONTAINER_BITS).alias("k0")).agg(
        listed.alias("words"), F.sum("n").alias("n")
    )
    containers = stored(containers, "bitmap-containers")

    def earlier(table: DataFrame, level: int) -> DataFrame:
        """The rows of smaller keys in the same block of the directory."""
        within = Window.partitionBy("tree", *(["up"] if level + 1 < DIRECTORY_LEVELS else [])).orderBy(f"k{level}")
        before = F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1))
        return table.withColumn("before", F.coalesce(before, F.lit(0)).cast("long"))

    levels, table = [], containers.select("tree", "k0", "n")
    for level in range(DIRECTORY_LEVELS):
        table = table.withColumn("up", F.shiftright(f"k{level}", DIRECTORY_BITS))
        levels.append(earlier(table, level))
        table = table.groupBy("tree", F.col("up").alias(f"k{level + 1}")).agg(F.sum("n").alias("n"))
    base = levels[-1]
    for level in reversed(range(DIRECTORY_LEVELS - 1)):
        upper = base.select("tree", F.col(f"k{level + 1}").alias("up"), F.col("before").alias("__base"))
        base = levels[level].join(upper, ["tree", "up"]).withColumn("before", F.col("before") + F.col("__base"))
    counted = F.transform(
        "words",
        lambda w, i: F.struct(
            w["word"].alias("word"),
            w["bits"].alias("bits"),
            w["n"].alias("n"),
            F.aggregate(F.slice("words", F.lit(1), i), F.col("before"), lambda s, x: s + x["n"]).alias("before"),
        ),
    )
    full = containers.drop("n").join(base.select("tree", "k0", "before"), ["tree", "k0"])
    return full.select("tree", F.inline(counted))


def _rank(bits: Column, position: Column) -> Column:
    """The bits below a position."""
    below = F.when(position == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(64) - position)
    )
    return F.bit_count(bits.bitwiseAND(below))


def leaf_places(rows: DataFrame) -> DataFrame:
    """`rows` (tree, id long, digest, other) with pos: rows before it in its tree, by id, nulls first, then digest.

    Rows that are equal in all columns are told apart by chance, which changes nothing.
    """
    directory = rank_directory(bitmap_words(rows))
    keyed = rows.withColumn("word", _word(F.col("id")))
    met = keyed.join(directory, ["tree", "word"])
    crowded = F.col("n") > F.bit_count("bits")
    pos = F.when(~crowded, F.col("before") + _rank(F.col("bits"), _position(F.col("id"))))
    met = stored(met.select("tree", "id", "digest", "other", "word", "before", pos.alias("pos")), "ranked")
    columns = ["tree", "id", "digest", "other", "pos"]
    shared = met.where(F.col("pos").isNull())
    single = met.where(F.col("pos").isNotNull()).select(*columns)
    return single if shared.isEmpty() else single.unionByName(_shared_places(shared).select(*columns))


def _shared_places(rows: DataFrame) -> DataFrame:
    """Places of rows in words where some id occurs more than once.

    Equal rows count as one with a number. The others are dealt by id and the first digits of their digest, so that
    no window holds more than a few thousandths of the rows of an id.
    """
    key = ["tree", "word", "given", "at", "part"]
    distinct = rows.groupBy("tree", "word", "id", "digest", "other", "before").agg(F.count("*").alias("m"))
    distinct = distinct.withColumns(
        {
            "given": F.col("id").isNotNull(),  # rows without an id come first
            "at": F.coalesce("id", F.lit(0)),
            "part": F.hex(F.substring("digest", 1, 2)).substr(1, 3),
        }
    )
    sums = lambda window: F.coalesce(
        F.sum("m").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).cast("long")
    parts = distinct.groupBy(*key).agg(F.sum("m").alias("m"))
    ahead = sums(Window.partitionBy("tree", "word").orderBy("given", "at", "part"))
    placed = distinct.withColumn("within", sums(Window.partitionBy(*key).orderBy("digest")))
    placed = placed.join(parts.select(*key, ahead.alias("ahead")), key).select(
        "tree", "id", "digest", "other", "m", (F.col("before") + F.col("ahead") + F.col("within")).alias("first")
    )
    portions = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(PORTION).cast("long")))
    portioned = placed.withColumn("from", portions).repartition("tree", "id", "digest", "from")
    last = F.least(F.col("m"), F.col("from") + PORTION) - 1
    return portioned.withColumn("k", F.explode(F.sequence("from", last))).withColumn("pos", F.col("first") + F.col("k"))


# ---- levels


def node(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as hex text, one after the other."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def levels_of(digests: list[bytes], whole: bool) -> list[list[bytes]]:
    """The levels of a block from its digests up. `whole` blocks are reduced `ROUND` times, as they are part of a
    larger tree; else until one node remains."""
    levels = [digests]
    while len(levels) <= ROUND if whole else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([node(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[bytes]], slot: int) -> Iterator[tuple[bytes, bytes]]:
    """What stands left and right of a slot's ancestors in their runs, from the slot's own run up."""
    for level in levels[:-1]:
        first = slot - slot % ARITY
        yield b"".join(level[first:slot]), b"".join(level[slot + 1 : first + ARITY])
        slot //= ARITY


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and the siblings on its way up give."""
    for left, right in path:
        digest = hashlib.sha256((left + digest + right).hex().encode()).digest()
    return digest


def proof_digest(path: list[tuple[bytes, bytes]]) -> bytes:
    return hashlib.sha256(b"".join(itertools.chain.from_iterable(path)).hex().encode()).digest()


def _whole(block: int, n: int) -> bool:
    return block > 0 or n == SPAN


def _blocks(items: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, block, node, digest, *carried) from (tree, pos, digest, *carried): slot arrays and what they reduce to."""
    kinds = {c: items.schema[c].dataType.simpleString() for c in carried}
    block, slot = F.expr(f"pos div {SPAN}").alias("block"), F.expr(f"cast(pos % {SPAN} as int)").alias("slot")
    dealt = items.select("tree", block, slot, "digest", *carried).repartition("tree", "block")
    dealt = dealt.sortWithinPartitions("tree", "block")
    schema = "tree string, block long, node binary, digest array<binary>" + "".join(f", {c} array<{kinds[c]}>" for c in carried)

    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        order = np.empty(table.num_rows, np.int64)  # the row of each slot
        order[table["slot"].to_numpy()] = np.arange(table.num_rows)
        table = table.take(pa.array(order)).combine_chunks()
        digests = table["digest"].to_pylist()
        tree, block = table["tree"][0], table["block"][0]
        top = levels_of(digests, _whole(block.as_py(), len(digests)))[-1][0]
        lists = [pa.array([table[c].to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("digest", *carried)]
        head = [pa.array([tree.as_py()], pa.string()), pa.array([block.as_py()], pa.int64()), pa.array([top], pa.binary())]
        return pa.record_batch([*head, *lists], ["tree", "block", "node", "digest", *carried])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            pairs = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
            start = 0
            for now, run in itertools.groupby(pairs):
                stop = start + sum(1 for _ in run)
                if now != key:
                    if rows:
                        yield made(rows)
                    key, rows = now, []
                rows.append(batch.slice(start, stop - start))
                start = stop
        if rows:
            yield made(rows)

    return stored(map_arrow(dealt, work, schema), "merkle-blocks")


def _rounds(items: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Rounds of blocks from the items up; in the last one every tree is one block."""
    rounds = [_blocks(items, carried)]
    while not rounds[-1].where(F.col("block") > 0).isEmpty():
        above = rounds[-1].select("tree", F.col("block").alias("pos"), F.col("node").alias("digest"))
        rounds.append(_blocks(above, []))
    return rounds


_ARROW = {
    "string": pa.string(),
    "long": pa.int64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<binary>": pa.list_(pa.binary()),
}
_PATH = "path array<binary>, subroot binary, root binary"


def _pairs(path: list[bytes]) -> list[tuple[bytes, bytes]]:
    return list(zip(path[::2], path[1::2], strict=True))


def _down(blocks: DataFrame, paths: DataFrame, schema: str, rows_of: Callable) -> DataFrame:
    """`rows_of(row, levels, path)` of every block; paths: tree, block, path (left, right, left, ...), subroot, root."""
    met = blocks.join(paths, ["tree", "block"])
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    kinds = [_ARROW[t] for t in types]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                levels = levels_of(row["digest"], _whole(row["block"], len(row["digest"])))
                columns = zip(*rows_of(row, levels, row["path"]), strict=True)
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return map_arrow(met, work, schema)


def _path_of(levels: list[list[bytes]], slot: int, above: list[bytes]) -> list[bytes]:
    return [*itertools.chain.from_iterable(siblings(levels, slot)), *above]


def _children(row: dict, levels: list, path: list[bytes]) -> Iterator[tuple]:
    """The paths of the blocks below a block."""
    for slot in range(len(levels[0])):
        yield row["tree"], row["block"] * SPAN + slot, _path_of(levels, slot, path), row["subroot"], row["root"]


def _groups(row: dict, levels: list, path: list[bytes]) -> Iterator[tuple]:
    """The paths of the top blocks of the groups below a block of the tree of groups."""
    for slot, (digest, name) in enumerate(zip(levels[0], row["name"], strict=True)):
        yield name, 0, _path_of(levels, slot, path), digest, row["root"]


def _proved(row: dict, levels: list, path: list[bytes], with_path: bool) -> Iterator[tuple]:
    above, root = _pairs(path), row["root"]
    for slot, (digest, other, id_) in enumerate(zip(levels[0], row["other"], row["id"], strict=True)):
        way = [*siblings(levels, slot), *above]
        folded = fold(digest if other is None else other, way)
        listed = [*itertools.chain.from_iterable(way)] if with_path else None
        place = row["block"] * SPAN + slot
        yield id_, row["tree"], place, digest, row["subroot"], root, proof_digest(way), folded, folded == root, listed


def _ordered(groups: DataFrame) -> DataFrame:
    """(tree, pos, digest, name): the groups by name in one tree. One row a group is dealt in ranges of names."""
    dealt = groups.select(F.col("tree").alias("name"), F.col("node").alias("digest")).repartitionByRange("name")
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "merkle-groups")
    # as many rows as there are ranges
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    placed = dealt.withColumn("place", place).join(sizes, "part")
    return placed.select(F.lit("").alias("tree"), (F.col("before") + F.col("place")).alias("pos"), "digest", "name")


def manifest_of(leaves: DataFrame, with_path: bool = False) -> DataFrame:
    """Proofs of leaves (tree string, id long, digest binary, other binary).

    One row per leaf: id, tree, position, digest, subroot, root, proof, folded, verified, and path, the siblings
    left and right of the way up (null unless `with_path`). folded is the root that `other`, or the digest where
    that is null, gives with the siblings. A null tree and an empty one are different; nulls come first.
    """
    named = F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "tree"))
    leaves = stored(leaves.select(named.alias("tree"), "id", "digest", "other"), "leaves")
    rounds = _rounds(leaf_places(leaves), ["id", "other"])
    upper = _rounds(_ordered(rounds[-1]), ["name"])
    paths = upper[-1].select(
        "tree",
        "block",
        F.expr("cast(array() as array<binary>)").alias("path"),
        F.lit(None).cast("binary").alias("subroot"),
        F.col("node").alias("root"),
    )
    below = f"tree string, block long, {_PATH}"
    for blocks in reversed(upper[1:]):
        paths = _down(blocks.drop("node"), paths, below, _children)
    paths = stored(_down(upper[0].drop("node"), paths, below, _groups), "merkle-paths")
    for blocks in reversed(rounds[1:]):
        paths = stored(_down(blocks.drop("node"), paths, below, _children), "merkle-paths")
    schema = (
        "id long, tree string, position long, digest binary, subroot binary, root binary, proof binary, "
        "folded binary, verified boolean, path array<binary>"
    )
    proved = _down(rounds[0].drop("node"), paths, schema, partial(_proved, with_path=with_path))
    unnamed = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return proved.withColumn("tree", unnamed)


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    altered: dict[str, Column] | None = None,
    where: Column | None = None,
    with_path: bool = False,
) -> DataFrame:
    """A Merkle manifest over `docs`, and whether rows altered afterwards still agree with it.

    A leaf is the digest of the `fields`. Leaves of a group stand by id, rows without an id first and rows that
    share an id by digest; groups stand by their names' bytes, rows without a group first. `altered` gives columns
    that replace fields where `where` holds; such rows are held against the manifest of the unaltered ones.
    Returns what `manifest_of` does, with the digests as bytes. Repeated rows are leaves each, null and empty
    texts differ, an empty table gives an empty result, and other columns are not read. Texts are read once, by
    Spark's own functions; tasks hold blocks of `SPAN` digests.
    """
    columns = [F.col(c) for c in fields]
    changed = [(altered or {}).get(c, F.col(c)) for c in fields]
    other = F.lit(None).cast("binary")
    if altered:
        other = F.when(F.lit(True) if where is None else where, leaf_digest(*changed))
    leaves = docs.select(
        F.col(group_col).cast("string").alias("tree"),
        F.col(id_col).cast("long").alias("id"),
        leaf_digest(*columns).alias("digest"),
        other.alias("other"),
    )
    return manifest_of(leaves, with_path)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    joined = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    found = merkle_manifest(read(spark, sf_dir, "documents"), altered={"text": joined}, where=tampered)
    shown = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"),
        shown("digest").alias("leaf"),
        shown("subroot").alias("subroot"),
        shown("root").alias("root"),
        shown("proof").alias("proof_sha256"),
        shown("folded").alias("folded_root"),
        "verified",
    )


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


OP11_SQL = f"""
WITH RECURSIVE crcs AS (SELECT {_crc_table()}::BIGINT[] AS t),
framed AS (
  SELECT doc_id, source, text, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), 4294967295::BIGINT) AS crc
  FROM documents, crcs
), hashed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-'
      ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) END AS other
  FROM framed
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    row_number() OVER () AS k FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, pos // 3
), tops AS (
  SELECT tree, arg_max(digest, level) AS subroot FROM nodes GROUP BY tree
), placed AS (SELECT tree AS name, subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM tops
), upper_nodes AS (
  SELECT 0 AS level, pos, subroot AS digest FROM placed
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM upper_nodes) WHERE n > 1 GROUP BY level, pos // 3
), root AS (SELECT arg_max(digest, level) AS root FROM upper_nodes
), runs AS (
  SELECT tree, level, pos,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r,
    max(level) OVER (PARTITION BY tree) AS top
  FROM (SELECT * FROM nodes UNION ALL SELECT '#', level, pos, digest FROM upper_nodes)
), way AS (
  SELECT k, tree, 0 AS level, pos, coalesce(other, leaf) AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT k, way.tree, way.level + 1, way.pos // 3, sha256(l || folded || r), proof || l || r
  FROM way JOIN runs ON runs.tree = way.tree AND runs.level = way.level AND runs.pos = way.pos AND way.level < top
), climbed AS (SELECT k, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM way GROUP BY k
), upper_way AS (
  SELECT k, 0 AS level, placed.pos, folded, proof FROM climbed JOIN leaves USING (k) JOIN placed ON name = tree
  UNION ALL
  SELECT k, way.level + 1, way.pos // 3, sha256(l || folded || r), proof || l || r
  FROM upper_way way JOIN runs ON runs.tree = '#' AND runs.level = way.level AND runs.pos = way.pos AND way.level < top
), proved AS (SELECT k, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM upper_way GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN tops USING (tree) JOIN proved USING (k), root
"""
