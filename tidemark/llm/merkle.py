"""Merkle manifest of a corpus: per language an eight-ary hash tree over its rows, and one over the languages.

All hashing is Spark SQL. Leaves get their positions by one range exchange. Blocks of ``8 ** DEPTH``
consecutive nodes of a tree lie in one row as an ordered array; ``sequence``, ``transform``, ``slice`` and
``aggregate`` collapse it level by level, and the block roots are the nodes of the next turn, until each
tree has one node. On the way back a block hands each of its nodes the siblings on its path, and joins
those of the block's own root: a join on the key by which blocks were made, never on a leaf.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import positions
from .scratch import Scratch

FAN = 8
#: Levels that a block collapses: blocks have at most ``FAN ** DEPTH`` nodes.
DEPTH = 3
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings left and right of a node, one entry a level, from the leaves up.
PATH = "array<struct<before:string,after:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; a text without other than ASCII characters takes the fast way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def leaf(values: dict[str, Column]) -> Column:
    """The hash of a row's fields: ``-`` for null, else byte count, colon and value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values.values()]
    return sha(F.concat(*parts))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, changed``: ``changed`` is the leaf of the tampered row, null where none is."""
    values = {c: F.col(c).cast("string") for c in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = F.when(hit, leaf(values | {"text": ascii_lower(values["text"])}))
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(values).alias("leaf"), changed.alias("changed"))


def height(nodes: Column) -> Column:
    """Levels over the nodes of a block whose whole tree has ``nodes`` now."""
    out = F.lit(DEPTH)
    for level in range(DEPTH - 1, -1, -1):
        out = F.when(nodes <= FAN**level, level).otherwise(out)
    return out


def collapsed(nodes: Column, levels: Column) -> Column:
    """All levels of a block, from its own nodes to its root: an array of arrays of digests."""

    def up(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda r: sha(joined(F.slice(below, r * FAN + 1, FAN))))

    grown = F.aggregate(F.sequence(F.lit(1), levels), F.array(nodes), lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))
    return F.when(levels > 0, grown).otherwise(F.array(nodes))


def path(tree: Column, place: Column, levels: Column) -> Column:
    """The siblings of node ``place`` (from 0) on each level of a block."""

    def at(level: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(FAN)), level)).cast("int")
        first = own - own % FAN
        run = F.slice(F.element_at(tree, level + 1), first + 1, FAN)
        inside = own - first
        return F.struct(joined(F.slice(run, F.lit(1), inside)).alias("before"), joined(F.slice(run, inside + 2, FAN)).alias("after"))

    return F.when(levels > 0, F.transform(F.sequence(F.lit(0), levels - 1), at)).otherwise(F.array().cast(PATH))


def folded(digest: Column, siblings: Column) -> Column:
    """The root that a node and the siblings on its path give."""
    return F.aggregate(siblings, digest, lambda h, s: sha(F.concat(s["before"], h, s["after"])))


class Forest:
    """One tree per ``key`` over ``nodes(key, pos, n, digest, payload)``: ``n`` is the tree's number of nodes."""

    def __init__(self, scratch: Scratch, nodes: DataFrame):
        self.turns: list[DataFrame] = []
        rest, most = nodes, 2
        while most > 1:
            blocks = scratch.save(self.blocks(rest), f"blocks{len(self.turns)}")
            self.turns.append(blocks)
            rest = blocks.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at(F.element_at("tree", -1), 1).alias("digest"), F.lit(None).cast("string").alias("payload"))
            most = rest.agg(F.max("n").alias("m")).first()["m"] or 1
        self.roots = rest.select("key", "digest")

    @staticmethod
    def blocks(nodes: DataFrame) -> DataFrame:
        """``key, block, n, levels, members, tree``: a row per block of consecutive nodes."""
        gathered = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).alias("members"))
        levels = height(F.col("n"))
        return gathered.select("key", "block", "n", levels.alias("levels"), "members", collapsed(F.col("members.digest"), levels).alias("tree"))

    def paths(self, above: DataFrame) -> DataFrame:
        """``key, pos, digest, payload, path, extra`` of all nodes; ``above(key, block, upper, extra)`` are the
        paths of the roots, and what else every node of the tree is to get."""
        for blocks in reversed(self.turns):
            upper = above.select(F.col("key").alias("__key"), F.col("block").alias("__block"), "upper", "extra")
            met = blocks.join(upper, F.col("key").eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block")))
            place = lambda m: (m["pos"] - F.col("block") * BLOCK).cast("int")
            each = F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["digest"].alias("digest"), m["payload"].alias("payload"), F.concat(path(F.col("tree"), place(m), F.col("levels")), F.col("upper")).alias("path")))
            nodes = met.select("key", "extra", F.inline(each))
            above = nodes.select("key", F.col("pos").alias("block"), F.col("path").alias("upper"), "extra")
        return nodes


def merkle(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``docs``.

    Rows are ordered in a language by id, null first, and rows of one id by their leaf; so repeated rows are
    leaves of their own and all have results. Languages that are null form a tree of their own, before the
    others. Rows without an id are never tampered with. A tree of one node is that node, so a corpus of one
    row has its leaf as root and the hash of an empty string as proof. An empty table gives an empty result;
    columns other than the five hashed ones are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    rows = scratch.save(leaves(docs), "leaves")
    placed = positions(rows, ["lang"], ["doc_id", "leaf"], size="n")
    forest = Forest(scratch, placed.select(F.col("lang").alias("key"), "pos", "n", F.col("leaf").alias("digest"), F.struct("doc_id", "changed").alias("payload")))
    subroots = scratch.save(forest.roots, "subroots")
    ordered = positions(subroots.select(F.lit(0).alias("one"), F.col("key").alias("payload"), "digest"), ["one"], ["payload"], size="n")
    top = Forest(scratch, ordered.select(F.col("one").alias("key"), "pos", "n", "digest", "payload"))
    none = F.array().cast(PATH)
    crown = top.paths(top.roots.select("key", F.lit(0).cast("long").alias("block"), none.alias("upper"), F.col("digest").alias("extra")))
    above = crown.select(F.col("payload").alias("key"), F.lit(0).cast("long").alias("block"), F.col("path").alias("upper"), F.struct(F.col("digest").alias("subroot"), F.col("extra").alias("root")).alias("extra"))
    found = forest.paths(scratch.save(above, "crown"))
    siblings = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    return found.select(
        "payload.doc_id",
        F.col("digest").alias("leaf"),
        "extra.subroot",
        "extra.root",
        sha(joined(siblings)).alias("proof_sha256"),
        folded(F.coalesce("payload.changed", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL twin unrolls; 8 ** 6 rows a language.
_SQL_LEVELS = 6


def _levels_sql(first: str, key: str, node: str) -> str:
    """Common table expressions ``{node}0, {node}1 ... (key, pos, h)`` over ``first``; a key's last node stays."""
    out = [f"{node}0 as ({first})"]
    for i in range(1, _SQL_LEVELS + 1):
        below = f"(select *, count(*) over (partition by {key}) as n from {node}{i - 1})"
        out.append(f"{node}{i} as (select {key}, pos // 8 as pos, case when max(n) = 1 then min(h) else sha256(string_agg(h, '' order by pos)) end as h from {below} group by {key}, pos // 8)")
    return ",\n".join(out)


def merkle_sql() -> str:
    """DuckDB SQL for ``merkle`` over ``documents``."""
    enc = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    row = lambda text: "sha256(" + " || ".join([*(enc(c) for c in FIELDS[:4]), enc(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # siblings of each leaf: a level's run without the own node; none once the tree has one node
    at = lambda node, key, i: f"(select *, count(*) over (partition by {key}) as n from {node}{i})"
    sib = lambda node, on, pos, i, side: f"coalesce((select string_agg(s.h, '' order by s.pos) from {node}{i} s where {on} and s.pos // 8 = {pos} // {8 ** (i + 1)} and s.pos {side} {pos} // {8**i} and c.{node}n{i} > 1), '')"
    digests, names = "coalesce(changed, leaf)", []
    for node, on, pos in (("t", "s.lang is not distinct from c.lang", "c.pos"), ("u", "true", "c.top")):
        for i in range(_SQL_LEVELS):
            names += [(f"{node}b{i}", sib(node, on, pos, i, "<")), (f"{node}a{i}", sib(node, on, pos, i, ">"))]
    sizes = ", ".join([f"(select count(*) from t{i} x where x.lang is not distinct from l.lang) as tn{i}" for i in range(_SQL_LEVELS)] + [f"(select count(*) from u{i}) as un{i}" for i in range(_SQL_LEVELS)])
    proof = " || ".join(f"{n}{s}{i}" for n in "tu" for i in range(_SQL_LEVELS) for s in "ba")
    folds, last = [], digests
    for n in "tu":
        for i in range(_SQL_LEVELS):
            folds.append(f"f{n}{i} as (select *, case when {n}n{i} > 1 then sha256({n}b{i} || {last} || {n}a{i}) else {last} end as h{n}{i} from {'paths' if not folds else folds[-1].split(' as ')[0]})")
            last = f"h{n}{i}"
    final = folds[-1].split(" as ")[0]
    return f"""with recursive k(i, v, s) as (select i, i, 0 from (select unnest(range(256)) as i) union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, s + 1 from k where s < 8),
tab as (select list(v order by i) as t from k where s = 8),
d as (select *, cast(doc_id as varchar) as dt from documents),
crc as (select cid, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(dt, ''), lambda c: cast(ascii(c) as bigint))), lambda a, b: xor(tab.t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) as crc from (select distinct doc_id as cid, dt from d where dt is not null), tab),
l0 as (select d.doc_id, d.lang, {row('text')} as leaf, case when crc.crc % 3 = 0 then {row(lower)} end as changed from d left join crc on crc.cid = d.doc_id),
leafs as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from l0),
{_levels_sql('select lang, pos, leaf as h from leafs', 'lang', 't')},
subs as (select lang, h, row_number() over (order by lang nulls first) - 1 as pos from t{_SQL_LEVELS}),
{_levels_sql('select 0 as one, pos, h from subs', 'one', 'u')},
langs as (select l.lang, l.h as subroot, l.pos as top, {sizes} from subs l),
c as (select leafs.*, langs.* exclude (lang) from leafs join langs on leafs.lang is not distinct from langs.lang),
paths as (select c.*, {', '.join(f'{e} as {n}' for n, e in names)} from c),
{', '.join(folds)}
select doc_id, leaf, subroot, (select h from u{_SQL_LEVELS}) as root, sha256({proof}) as proof_sha256, {last} as folded_root, {last} = (select h from u{_SQL_LEVELS}) as verified from {final}"""
