"""From LSH buckets to components of exactly verified links.

A bucket holds ids that share a band key.  Comparing all pairs of a bucket is
never needed for components: ids that are already connected need no further
comparison.  So each bucket is first compared with one member (a star); the
links found are contracted; only buckets that still hold several components go on.
Members that can have no further link are taken out by an exact bound; the rest
are compared with another member, and at last pair by pair across components,
block against block.  Every pair of a bucket thus ends up verified,
connected or shown to be no link, and no link between components is lost.

Sets are arrays, or anything that ``unpack`` makes arrays of where they are compared
(a text that is shorter than its set); such sets come with their exact ``size``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .marks import maybe_in
from .store import freed, written

#: Items of the sets that one block holds, and its members: a task compares the
#: members of two blocks pair by pair.
BLOCK_ITEMS = 1 << 18
BLOCK_MEMBERS = 1 << 9
#: 64-bit words of the bitmap that a set may carry.
WORDS = 4


Unpack = Callable[[Column], Column]


def _as_is(items: Column) -> Column:
    return items


def _sized(sets: DataFrame) -> DataFrame:
    return sets if "size" in sets.columns else sets.withColumn("size", F.size("items"))


def bitmap(item: str) -> Column:
    """Aggregate: bitmap of the hashed items of a set, as WORDS longs."""
    h = F.col(item)
    word = F.pmod(F.shiftright(h, 6), F.lit(WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    return F.array(*[F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0).cast("long")) for k in range(WORDS)])


def colliding(buckets: DataFrame) -> DataFrame:
    """Rows (key, id) of buckets with at least two ids, and the bucket's size
    and smallest id, as a written table.  Keys are counted before the shuffle; a bitmap of those that
    stand twice takes out most rows before they are shuffled with their ids."""
    twice = written(buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "twice")
    rest = written(maybe_in(buckets, "key", twice), "rest")
    many = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("centre")) \
        .filter("n > 1")
    members = written(rest.join(many.hint("shuffle_hash"), "key"), "members")
    freed(twice, rest)
    return members


def _sets_of(ids: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The rows of ``sets`` of distinct ``ids``.  The join is an inner one, as a
    semi join would be pushed below the bitmap."""
    ids = written(ids, name)
    return maybe_in(sets, "id", ids).join(ids, "id")


def _lone(x: Column, y: Column, words: int) -> Column:
    """Least number of items of x that y lacks: bits that are set in x only."""
    bits = [F.bit_count(x[k].bitwiseAND(F.bitwise_not(y[k]))) for k in range(words)]
    return sum(bits[1:], bits[0])


def _near_enough(x: Column, y: Column, num: int, den: int) -> Column:
    """False only if sizes and bitmaps prove the similarity to be too low."""
    common = F.least(x["size"] - _lone(x["bits"], y["bits"], WORDS), y["size"] - _lone(y["bits"], x["bits"], WORDS))
    return common * (den + num) >= (x["size"] + y["size"]) * num


def jaccard_links(pairs: DataFrame, sets: DataFrame, num: int, den: int, unpack: Unpack = _as_is) -> DataFrame:
    """Pairs (a, b) whose sets (id, items) have den * intersection >= num * union.
    Where ``sets`` has bitmaps, pairs that these rule out need no sets."""
    if "bits" in sets.columns:
        thin = sets.select("id", F.struct("size", "bits").alias("s"))
        pairs = written(pairs.join(thin.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
                        .join(thin.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
                        .filter(_near_enough(F.col("x"), F.col("y"), num, den)).select("a", "b"), "near")
    used = _sized(_sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), sets, "need"))
    left = used.select(F.col("id").alias("a"), F.col("items").alias("x"), F.col("size").alias("nx"))
    right = used.select(F.col("id").alias("b"), F.col("items").alias("y"), F.col("size").alias("ny"))
    # common * den >= (nx + ny - common) * num; sets are unpacked once, in one expression
    common = F.size(F.array_intersect(unpack(F.col("x")), unpack(F.col("y"))))
    return pairs.join(left, "a").join(right, "b") \
        .filter((F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num)
                & (common * (den + num) >= (F.col("nx") + F.col("ny")) * num)).select("a", "b")


def able(members: DataFrame, sets: DataFrame, num: int, den: int, unpack: Unpack = _as_is) -> DataFrame:
    """The members that can still have a link among these members: an item that
    no other member's set holds is in no intersection, so a set needs a share of
    num / den of items that others hold too.  Items of one id alone are counted
    where they are grouped, so that only the counts travel back.  Exact, also
    where an id has several sets or where sets of other ids come along: both
    only let more members stay."""
    own = _sized(maybe_in(sets, "id", written(members.select("id").distinct(), "ids")))
    sizes = own.groupBy("id").agg(F.sum("size").alias("total"), F.min("size").alias("least"))
    lone = own.select("id", F.explode(unpack(F.col("items"))).alias("x")).groupBy("x") \
        .agg(F.min("id").alias("id"), F.max("id").alias("hi")).filter("id = hi") \
        .groupBy("id").agg(F.count("*").alias("lone"))
    fit = sizes.join(lone, "id", "left") \
        .filter((F.col("total") - F.coalesce("lone", F.lit(0))) * den >= F.col("least") * num).select("id")
    return members.join(written(fit, "fit"), "id", "left_semi")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked(members: DataFrame, sets: DataFrame, num: int, den: int, unpack: Unpack = _as_is) -> DataFrame:
    """Components (id, root) of the true links among the members of buckets.

    ``members``: key, id, n, centre as given by :func:`colliding`; ``sets``: id,
    items for every member, and, where one row is one id's whole set, size and
    bits (see :func:`bitmap`)."""
    tested = written(members.filter("id <> centre").select(*_pair(F.col("id"), F.col("centre"))).distinct(),
                     "pairs")
    links = written(jaccard_links(tested, sets, num, den, unpack), "verified")
    roots = components(links)
    # a centre that all others were compared with has no pair left
    rest = written(_open(members.filter("id <> centre"), roots, 0), "open")
    if not rest.limit(1).count():
        return roots
    centres = rest.filter("id = centre").select("key", F.col("root").alias("rc"))
    star = rest.join(centres, "key").filter("root <> rc") \
        .select(*_pair(F.col("id"), F.col("centre"))).distinct()
    more = written(star.join(tested, ["a", "b"], "left_anti"), "pairs")
    links = written(links.union(jaccard_links(more, sets, num, den, unpack)), "verified")
    freed(tested, more)
    roots = components(links)

    rest = written(_open(rest.filter("id <> centre"), roots, 1), "open")
    if not rest.limit(1).count():
        return roots
    rest = written(_open(able(rest, sets, num, den, unpack), roots, 2), "open")
    if not rest.limit(1).count():
        return roots
    return components(written(links.union(_across(rest, sets, num, den, unpack)), "verified"))


def _across(rest: DataFrame, sets: DataFrame, num: int, den: int, unpack: Unpack = _as_is) -> DataFrame:
    """Links (a, b) between different components of open buckets.

    Buckets that share ids are one cloud, so that a pair of several buckets is
    looked at once.  A cloud is dealt to blocks of bounded size; each pair of
    blocks is one row, compared inside an expression that returns its links
    only: pairs are never rows.  Rows of blocks are dealt out by number, as they are
    small but long to compare."""
    clouds = components(rest.filter("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")))
    nodes = rest.groupBy("id").agg(F.min("root").alias("root"), F.collect_set("key").alias("keys")) \
        .join(clouds.select("id", F.col("root").alias("cloud")), "id")
    own = _sized(_sets_of(rest.select("id").distinct(), sets, "ids"))
    nodes = written(nodes.join(own, "id"), "nodes")
    what = ["id", "root", "keys", "size", "items"] + ["bits"] * ("bits" in sets.columns)
    volume = written(nodes.groupBy("cloud").agg(F.greatest(
        F.ceil(F.sum("size") / BLOCK_ITEMS), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("int").alias("blocks")), "volume")
    dealt = nodes.join(volume, "cloud") \
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = written(dealt.groupBy("cloud", "block").agg(
        F.max("blocks").alias("blocks"),
        F.collect_list(F.struct(*what)).alias("own")), "blocks")
    left = packed.select("cloud", F.col("block").alias("i"), F.col("own").alias("xs"),
                         F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    right = packed.select("cloud", "block", F.col("own").alias("ys"))
    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = left.join(right, ["cloud", "block"]).repartition(tasks, "cloud", "i", "block")

    def opened(side: str) -> Column:
        return F.transform(side, lambda x: F.struct(
            *(x[c].alias(c) for c in what if c != "items"), unpack(x["items"]).alias("items"))).alias(side)

    def link(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x["items"], y["items"]))
        able = _near_enough(x, y, num, den) if "bits" in what else F.lit(True)
        return (x["root"] != y["root"]) & ((F.col("i") != F.col("block")) | (x["id"] < y["id"])) \
            & (F.least(x["size"], y["size"]) * den >= F.greatest(x["size"], y["size"]) * num) \
            & F.arrays_overlap(x["keys"], y["keys"]) & able & (common * (den + num) >= (x["size"] + y["size"]) * num)

    found = F.flatten(F.transform("xs", lambda x: F.transform(
        F.filter("ys", lambda y: link(x, y)), lambda y: F.struct(x["id"].alias("u"), y["id"].alias("v")))))
    return sides.select("i", "block", opened("xs"), opened("ys")).select(F.explode(found).alias("p")) \
        .select(*_pair(F.col("p.u"), F.col("p.v"))).distinct()


def _open(members: DataFrame, roots: DataFrame, step: int) -> DataFrame:
    """Members (key, id, root, n, centre) of the buckets that hold several
    components; the centre is another one in each step."""
    now = members.select("key", "id").join(roots, "id", "left") \
        .select("key", "id", F.coalesce("root", "id").alias("root"))
    mark = F.xxhash64(F.lit(step), "id")
    still = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                   F.count("*").alias("n"), F.max(F.struct(mark, "id")).alias("top")) \
        .filter("lo <> hi").select("key", "n", F.col("top.id").alias("centre"))
    return now.join(still, "key")
