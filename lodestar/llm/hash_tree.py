"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, their racks, and the racks' shards, each shard with a weight; a rack weighs what its shards weigh, a
region what its racks do. A document goes down from the root: at each node every child draws -ln(u) / weight, where u comes
from a hash of the document's id and the child's name, and the least draw wins; so a child wins with a chance in proportion
to its weight. A draw hangs on nothing else, which confines movement: where a weight changes, the draws of other children
stay what they were, so documents move only between a child whose weight changed and its siblings, and nothing moves in
subtrees that hold no change, besides what leaves or enters them as a whole. A region that is added takes documents
only into itself (grown()).

Documents get their place in a shard (slot) in order of id, by one sort over ranges of the narrow rows and the number at
which each shard begins; no shard is ever one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairing import with_row_index
from .common import aliased, cut, pick

LAW = "key"
#: The shards of the tree that layout() starts from, racks a region and shards a rack.
BASE, RACKS, SHARDS = 16, 2, 2
#: Hex digits of md5 that make u, and their span: 52 bits are exact in a double.
DIGITS, SPAN = 13, float(1 << 52)


@dataclass(frozen=True)
class Shard:
    """A leaf; its number is its place in the tuple that is the tree."""

    region: str
    rack: str
    weight: float = 1.0


Tree = tuple[Shard, ...]


def grown(tree: Tree) -> Tree:
    """One shard more, in a region and a rack of its own, of the others' mean weight: the root alone has a new draw, so
    documents move only into the new shard."""
    n = len(tree)
    weight = sum(s.weight for s in tree) / n if n else 1.0
    return (*tree, Shard(f"region-{n}+", f"rack-{n}+", weight))


def layout(shards: int) -> Tree:
    """The tree of a number of shards: the first BASE (fewer: none) in full regions, each further one as grown() adds it. So a
    shard more takes documents only into itself, at any number from BASE on and below it."""
    base = BASE if shards >= BASE else 0
    tree: Tree = tuple(Shard(f"region-{i // (RACKS * SHARDS)}", f"rack-{i // SHARDS}") for i in range(base))
    while len(tree) < shards:
        tree = grown(tree)
    return tree


def levels(tree: Tree) -> tuple[list, list, list]:
    """(name, weight, at) of the regions, of the racks of each region and of the shards of each rack. `at` is the place of a
    child's own children on the next level; that of a shard is its number. Children of weight 0 are left out."""
    if any(s.weight < 0 for s in tree) or not any(s.weight for s in tree):
        raise ValueError("a tree needs weights of 0 or more, and one above 0")
    regions: dict[str, dict[str, list[tuple[str, float, int]]]] = {}
    for number, s in enumerate(tree):
        if s.weight:
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append((f"{s.region}/{s.rack}/{number}", float(s.weight), number))
    top, racks, shards = [], [], []
    for region, inside in regions.items():
        top.append((region, sum(w for leaves in inside.values() for _, w, _ in leaves), len(racks)))
        racks.append([])
        for rack, leaves in inside.items():
            racks[-1].append((f"{region}/{rack}", sum(w for _, w, _ in leaves), len(shards)))
            shards.append(leaves)
    return top, racks, shards


def _child(c: tuple[str, float, int]) -> str:
    name = c[0].replace("\\", "\\\\").replace("'", "\\'")
    return f"named_struct('name', '{name}', 'weight', {c[1]!r}D, 'at', {c[2]})"


def _children(nodes: list) -> str:
    return f"array({', '.join(_children(n) if isinstance(n, list) else _child(n) for n in nodes)})"


def _winner(children: str, key: str) -> str:
    """The place of the child with the least draw; equal draws (2^-52) go to the lesser place."""
    u = f"(cast(conv(substring(md5(cast(concat({key}, '/', c.name) as binary)), 1, {DIGITS}), 16, 10) as double) + 0.5D) / {SPAN!r}D"
    return f"array_min(transform({children}, c -> named_struct('draw', -ln({u}) / c.weight, 'at', c.at))).at"


def descend(d: DataFrame, tree: Tree, key: str, out: str = "shard", inner: tuple[str, str] = ("region", "rack")) -> DataFrame:
    """The rows of d with the region, rack and shard (numbers) that their key, a string, goes down to."""
    top, racks, shards = levels(tree)
    d = d.withColumn(inner[0], F.expr(_winner(_children(top), key)))
    d = d.withColumn(inner[1], F.expr(_winner(f"get({_children(racks)}, {inner[0]})", key)))
    return d.withColumn(out, F.expr(_winner(f"get({_children(shards)}, {inner[1]})", key)))


def shard_documents(df: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, size (bytes of the text, and 1), text_crc32, law, region, rack, shard, slot, grown_shard (with one
    shard more).

    Rows with equal ids, null ones too, share a shard: the id alone decides. Null text is empty. Slots number a shard's rows
    from 0 in order of id (null first), size and crc; rows equal in all three are interchangeable. Empty tables give empty
    results; further columns are not read. The texts are read once; what is sorted has a few numbers a row.
    """
    d = pick(df, {"doc_id": id_col, "text": text_col}).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    d = descend(descend(d, grown(tree), "key", "grown_shard"), tree, "key")
    # the number of a row splits equal rows over ranges; the checkpoint holds it fast
    d = cut(d.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "region", "rack", "shard", "grown_shard", F.monotonically_increasing_id().alias("nr")))
    d = with_row_index(d, "shard", "doc_id", "size", "text_crc32", "nr", name="place", narrow=True)
    first = d.groupBy("shard").agg(F.min("place").alias("first"))  # a row a shard of the tree
    d = d.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first"))
    return d.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, tree: Tree, path: str, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """The rows of df, all columns as they are, as Parquet in a folder a shard (shard=N). A shard's rows are dealt over as
    many tasks as the session shuffles to, whatever its share, and files hold at most rows_per_file rows. A column of df
    called `shard` is an error, as it would be lost among the folders' names."""
    if "shard" in {c.lower() for c in df.columns}:
        raise ValueError("documents have a column named shard")
    d, back = aliased(df)
    name = next(n for n, c in back.items() if c == id_col)
    d = descend(d.withColumn("key", F.coalesce(F.col(name).cast("string"), F.lit(""))), tree, "key")
    d = d.repartition("shard", F.pmod(F.xxhash64(*back), F.lit(64))).sortWithinPartitions("shard")
    d.select(*[F.col(n).alias(c) for n, c in back.items()], "shard").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def oracle_sql(shards: int = 16) -> str:
    tree = layout(shards)

    def nested(nodes: list) -> str:
        return f"[{', '.join(nested(n) if isinstance(n, list) else f"{{'name': '{n[0]}', 'weight': {n[1]}::double, 'at': {n[2]}}}" for n in nodes)}]"

    def winner(children: str) -> str:
        u = f"(cast(concat('0x', substring(md5(concat(key, '/', c.name)), 1, {DIGITS})) as bigint)::double + 0.5::double) / {SPAN}::double"
        return f"list_sort(list_transform({children}, lambda c: {{'draw': -ln({u}) / c.weight, 'at': c.at}}))[1].at"

    def down(of: Tree, prefix: str) -> tuple[str, str, str]:
        top, racks, leaves = levels(of)
        return winner(nested(top)), winner(f"{nested(racks)}[{prefix}region + 1]"), winner(f"{nested(leaves)}[{prefix}rack + 1]")

    (a, b, c), (ga, gb, gc) = down(tree, ""), down(grown(tree), "g")
    return f"""
with table8 as ({CRC_TABLE}),
d as (select doc_id, coalesce(cast(doc_id as varchar), '') as key, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size, {crc_sql("coalesce(text, '')")} as text_crc32 from documents, table8),
r as (select *, {a} as region, {ga} as gregion from d),
k as (select *, {b} as rack, {gb} as grack from r),
s as (select *, {c} as shard, {gc} as grown_shard from k)
select doc_id, size, text_crc32, '{LAW}' as law, cast(shard as integer) as shard, row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, cast(grown_shard as integer) as grown_shard from s
"""


def _bit(v: str) -> str:
    return f"(case when {v} % 2 = 1 then xor({v} // 2, 3988292384) else {v} // 2 end)"


#: DuckDB has no crc32: one row with the list t of what each byte value does, eight steps of the reflected polynomial.
CRC_TABLE = "select list(v8 order by i) as t from (select i, " + _bit("v7") + " as v8 from (select i, " + _bit("v6") + " as v7 from (select i, " + _bit("v5") + " as v6 from (select i, " + _bit("v4") + " as v5 from (select i, " + _bit("v3") + " as v4 from (select i, " + _bit("v2") + " as v3 from (select i, " + _bit("v1") + " as v2 from (select i, " + _bit("i") + " as v1 from (select unnest(range(256)) as i)))))))))"


def crc_sql(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8, where t is CRC_TABLE's list."""
    return f"cast(xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast(concat('0x', x) as bigint)), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295), 4294967295) as bigint)"
