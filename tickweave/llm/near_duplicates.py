"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set of word shingles gives ``COORDINATES`` MinHash values. Documents are
posted under their (coordinate, value) pairs; two documents that agree in at least
``MATCHES`` coordinates are a candidate pair, and candidates are confirmed on full sets.

* Equal sets are one class from the start, so copies never meet in a list.
* Prefix: a pair with ``MATCHES`` common postings shares one among the rarest
  ``COORDINATES - MATCHES + 1`` postings of either side. Only these are posted, so values
  that many documents share by chance are not joined on.
* Skip: each list first compares its members with one leader, another one in each of
  ``ROUNDS`` rounds. Members that this puts into one component need not be compared; only
  pairs across components are, at the end. So a list of n near copies costs about n comparisons.
* Long lists are compared inside tasks, in blocks of ``LIST_BLOCK`` members, and only links or
  few candidates leave a task. If a block has many candidates, their full sets are sent to
  the task, which confirms them itself.
* Size: sets of a similarity of 0.8 differ by a factor of 1.25 at most, so leaders are chosen
  by size class and pairs of other sizes are not formed.

With a true similarity of 0.8, fewer than 15 of 32 coordinates agree with probability
below 1e-5; confirmed pairs always have the exact similarity.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickweave.llm.common import (
    Powers, free_names, lower, mix, range_hashes, row_key, text_blocks, utf8, within, words, written,
)
from tickweave.llm.components import components

COORDINATES = 32
MATCHES = 15
ROUNDS = 2
SHORT = 32              # lists up to this length are joined with themselves
LIST_BLOCK = 2560
FEW = 2                 # candidate pairs for each member that a block may hand on
BLOCK = 2 << 20

_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_MASKS = mix(np.arange(101, 101 + COORDINATES, dtype=np.uint64))


def shingle_sets(data, offsets, size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and the offset of each text's set."""
    data = lower(data)
    starts, stops, at = words(data, offsets)
    each = range_hashes(data, starts, stops, powers)
    n_words = np.diff(at)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    first = np.concatenate(([0], np.cumsum(n_shingles)))
    begin = np.repeat(at[:-1], n_shingles) + within(first)
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    hashes = np.zeros(len(begin), np.uint64)
    length = np.minimum(n_words, size)[owner]
    for k in range(size):
        inside = k < length
        hashes[inside] = mix(hashes[inside] * np.uint64(31) + each[begin[inside] + k] + np.uint64(k))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    count = np.concatenate(([0], np.cumsum(new)))
    return hashes[new], count[first]


def set_names(hashes, offsets) -> list[bytes | None]:
    """128 bits that stand for a set; None for the empty set."""
    full = np.flatnonzero(np.diff(offsets))
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    if len(full):
        starts = offsets[:-1][full]
        both = np.stack((np.add.reduceat(mix(hashes), starts), np.add.reduceat(mix(hashes ^ _MASKS[0]), starts)), 1)
        raw = both.astype(">u8").tobytes()
        for i, k in enumerate(full):
            out[k] = raw[16 * i:16 * i + 16]
    return out


def signatures(hashes, offsets) -> np.ndarray:
    """(non-empty texts, COORDINATES) minima as signed 32-bit numbers."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), COORDINATES), np.int32)
    for j in range(COORDINATES if len(starts) else 0):
        values = ((hashes ^ _MASKS[j]) * _MULTIPLIERS[j] >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(values, starts).view(np.int32)
    return out


def signed(docs: DataFrame, size: int, *longs: str) -> DataFrame:
    """doc_id, ``set`` (its name), ``n_shingles``, ``signature`` of every row, and the columns ``longs`` as they are."""
    def run(batches):
        powers = Powers()
        for block in text_blocks(batches, "text", BLOCK):
            hashes, at = shingle_sets(*utf8(block.column("text")), size, powers)
            n = np.diff(at)
            ends = np.concatenate(([0], np.cumsum((n > 0) * COORDINATES))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(set_names(hashes, at), pa.binary()), pa.array(n),
                 pa.ListArray.from_arrays(ends, pa.array(signatures(hashes, at).ravel())), *map(block.column, longs)],
                names=["doc_id", "set", "n_shingles", "signature", *longs])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *longs).mapInArrow(
        run, ", ".join([f"doc_id {kind}, `set` binary, n_shingles long, signature array<int>", *[f"`{c}` long" for c in longs]]))


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``set`` and its ``shingles``, one row for each row with words."""
    def run(batches):
        powers = Powers()
        for block in text_blocks(batches, "text", BLOCK):
            hashes, at = shingle_sets(*utf8(block.column("text")), size, powers)
            lists = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(hashes.view(np.int64)))
            full = pa.array(np.diff(at) > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_names(hashes, at), pa.binary()), lists], names=["set", "shingles"]).filter(full)

    return docs.select("text").mapInArrow(run, "`set` binary, shingles array<long>")


def postings(classes: DataFrame) -> DataFrame:
    """``posting``, ``set`` and ``n_shingles`` for the rarest postings by which a candidate pair must meet."""
    every = classes.select("set", F.posexplode("signature").alias("place", "value")).select(
        "set", (F.col("place").cast("bigint") * F.lit(1 << 32) + F.col("value")).alias("posting"))
    shared = every.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")
    met = every.join(shared, "posting")
    mine = Window.partitionBy("set")
    ranked = (met.withColumn("rank", F.row_number().over(mine.orderBy("n", "posting")))
              .withColumn("of", F.count("*").over(mine)))
    ranked = ranked.withColumn("weight", F.sum("n").over(mine))
    met = ranked.where(F.col("rank") <= F.col("of") - (MATCHES - 1)).select("posting", "set", "weight")
    return met.join(classes.select("set", "n_shingles"), "set")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose signatures agree in at least MATCHES coordinates."""
    side = lambda k: classes.select(F.col("set").alias(k), F.col("signature").alias(f"s{k}"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(same >= MATCHES).select("a", "b")


def _sets_of(needed: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """The shingles of each of the ``needed`` sets, read from one of its documents."""
    readers = needed.join(classes.select("set", "reader"), "set").select(F.col("reader").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").where("text is not null")
    sets = full_sets(texts.join(readers, "doc_id", "left_semi").unionByName(texts.where("doc_id is null")), size)
    return written(sets.join(needed, "set", "left_semi").dropDuplicates(["set"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have a Jaccard similarity of at least ``percent`` / 100."""
    needed = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    sets = _sets_of(needed, docs, classes, size)
    side = lambda k: sets.select(F.col("set").alias(k), F.col("shingles").alias(f"s{k}"))
    common = F.size(F.array_intersect("sa", "sb"))
    joint = F.size("sa") + F.size("sb") - common
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(common.cast("bigint") * 100 >= joint.cast("bigint") * percent).select("a", "b"))


_KEY = ["posting", "low", "high"]


def _compare_block(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Candidate pairs across components, or one row without a pair if there are many; with ``shingles``, links.

    Members of the component with most members are only compared with the others. Links
    found on the way join components, so what they connect is not compared again.
    """
    sets = frame["set"].to_numpy()
    _, root = np.unique(frame["root"].to_numpy().astype("S16"), return_inverse=True)
    signature, n, block = np.stack(frame["signature"].to_numpy()), frame["n_shingles"].to_numpy(), frame["block"].to_numpy()
    full = frame["shingles"].to_numpy() if "shingles" in frame else None
    rest = root != np.bincount(root).argmax()
    both_ways = frame["low"].iloc[0] != frame["high"].iloc[0]
    later, out = np.arange(len(sets)), []
    for s in np.flatnonzero(rest):
        may = (root != root[s]) & (~rest | (later > s)) & (np.minimum(n, n[s]) * 100 >= np.maximum(n, n[s]) * percent)
        may &= (block != block[s]) if both_ways else True
        near = np.flatnonzero(may)
        near = near[(signature[near] == signature[s]).sum(1) >= MATCHES]
        if full is None:
            out += [(sets[s], sets[k]) for k in near]
            if len(out) > FEW * len(sets):
                out = [(None, None)]
                break
        elif len(near):
            each = np.concatenate(full[near])
            owner = np.repeat(np.arange(len(near)), n[near])
            common = np.bincount(owner[np.isin(each, full[s])], minlength=len(near))
            for k in near[common * 100 >= (n[near] + n[s] - common) * percent]:
                if root[k] != root[s]:
                    out.append((sets[s], sets[k]))
                    root[root == root[k]] = root[s]
    return frame[_KEY].iloc[[0] * len(out)].assign(a=[a for a, _ in out], b=[b for _, b in out])


def _grouped(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists that hold several components, with each member's component."""
    groups = components(links).withColumnRenamed("node", "set")
    member = written(lists.drop("root").join(groups, "set", "left").withColumn("root", F.coalesce("root", "set")), "members")
    mixed = member.groupBy("posting").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return member.join(mixed.select("posting"), "posting")


def linked_sets(docs: DataFrame, signs: DataFrame, size: int, percent: int) -> DataFrame:
    """``node`` and ``root`` of every set that is linked with another one."""
    classes = written(
        signs.where("set is not null").groupBy("set", "n_shingles").agg(
            F.min("doc_id").alias("reader"), F.first("signature").alias("signature")), "classes")
    width = float(np.log(100 / percent)) * (1 + 1e-9)       # so that rounding never puts a pair two classes apart
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / width)
    lists = written(postings(classes).withColumn("class", size_class), "postings")

    open_lists = lists.withColumn("root", F.col("set"))
    links = None
    for k in range(ROUNDS):
        order = F.xxhash64("posting", "set", F.lit(k)) if k else -F.col("weight")     # first the one with most company
        leaders = open_lists.groupBy("posting", "class").agg(
            F.min(F.struct(order.alias("order"), F.col("set").alias("a"), F.col("root").alias("ra"))).alias("leader"))
        met = open_lists.join(leaders, ["posting", "class"]).where("set <> leader.a and root <> leader.ra")
        stars = met.select(F.least("set", "leader.a").alias("a"), F.greatest("set", "leader.a").alias("b")).distinct()
        stars = written(_agreeing(stars, classes), "pairs")
        found = written(_confirmed(stars, docs, classes, size, percent), "confirmed")
        links = found if links is None else links.unionByName(found)
        open_lists = _grouped(lists, links)

    lengths = open_lists.groupBy("posting").agg(F.count("*").alias("members"))
    sized = written(open_lists.join(lengths, "posting"), "open")
    short, long = sized.where(F.col("members") <= SHORT), sized.where(F.col("members") > SHORT)
    a = short.select("posting", F.col("set").alias("a"), F.col("root").alias("ra"), F.col("n_shingles").alias("na"))
    b = short.select("posting", F.col("set").alias("b"), F.col("root").alias("rb"), F.col("n_shingles").alias("nb"))
    alike = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    across = a.join(b, "posting").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & alike).select("a", "b")

    blocks = F.ceil(F.col("members") / LIST_BLOCK)
    placed = long.withColumn("block", F.pmod(F.xxhash64("set", F.lit(4)), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    placed = placed.select("posting", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                           "block", "set", "root", "n_shingles")
    signed_members = placed.join(classes.select("set", "signature"), "set")
    shape = "posting long, low long, high long, a binary, b binary"
    compared = written(signed_members.groupBy(*_KEY).applyInPandas(lambda f: _compare_block(f, percent), shape), "compared")
    few = compared.where("a is not null").select("a", "b")
    across = across.unionByName(few).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    across = written(_agreeing(across, classes), "pairs")
    many = signed_members.join(compared.where("a is null").select(*_KEY), _KEY)
    sets = _sets_of(many.select("set").distinct(), docs, classes, size)
    direct = many.join(sets, "set").groupBy(*_KEY).applyInPandas(lambda f: _compare_block(f, percent), shape)
    found = _confirmed(across, docs, classes, size, percent).unionByName(direct.select("a", "b"))
    return components(links.unionByName(found))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached by links) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. With fewer than ``size`` words
    the whole sequence is the one shingle; without words, or for a null text, the set is
    empty and links with nothing: such a row is its own component. Rows with a null doc_id
    take part, and a component of such rows alone has a null id. Rows that repeat a doc_id
    are separate rows with their own sets. Other columns of ``docs`` are not used.
    """
    signs = written(signed(docs, size), "signatures")
    groups = linked_sets(docs, signs, size, percent)
    rows = signs.select("doc_id", "set", "n_shingles").join(groups.withColumnRenamed("node", "set"), "set", "left")
    rows = rows.withColumn("root", F.coalesce("root", "set"))
    smallest = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    return rows.join(smallest, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def stays(component_id: Column, doc_id: Column) -> Column:
    """Whether a row is its component's kept document; rows of components without any id stay."""
    return component_id.eqNullSafe(doc_id)


def without_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that with the least doc_id (null last).

    This is decided row by row: of rows that repeat a doc_id, or have none, a component
    keeps one at most, by its words and then a hash of all columns. Rows without words are
    components of their own and all stay.
    """
    h, g = free_names(docs, "h", "g")
    keyed = docs.withColumns(dict(zip((h, g), row_key(docs))))
    signs = written(signed(keyed, size, h, g), "signatures")
    groups = linked_sets(docs, signs, size, percent).withColumnRenamed("node", "set")
    joined = signs.where("set is not null").select("doc_id", "set", h, g).join(groups, "set", "left")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set", h, g)).alias("least")
    kept = joined.groupBy(F.coalesce("root", "set").alias("root")).agg(least).select(f"least.{h}", f"least.{g}")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # equal rows become one in each task before they are shuffled
    stay = keyed.where(has_words).dropDuplicates([h, g]).join(written(kept, "kept"), [h, g], "left_semi")
    return stay.select(*docs.columns).unionByName(docs.where(~has_words))
