"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line; longer ones are cut into pieces from their start. The
piece length follows the length of the text in powers of two, so that a short
text has enough pieces to compare; a fingerprint holds two tables, for the piece
length and its double, so that texts of about one length always share one.
Each distinct digest is put into one cell of each of three sub-tables. A cell
holds a count, the exclusive-or of its digests and of their check values.

Subtracting two tables cell by cell leaves the digests that only one side has.
Peeling takes them out: a cell with count +-1 whose check value fits holds a
single digest, which is removed from its other cells, and so on. If something is
left, the tables were too small, and larger ones (digests dealt by hash into
parts of a table each) are built and subtracted. A part that fails is tried again
by itself, with twice as many cells and other places each time, and in the end its
two sets are compared directly, so that the differences are always found.

Texts whose piece lengths lie further apart are compared at the larger one.

Everything is DataFrame expressions inside one row; the only shuffle deals
documents into ranges of ids, so that each can see the text that follows it.

Nulls and ties: a null text is empty; two texts without paragraphs have likeness
1. Documents are ordered by id, then by digest of the text; null ids come first.
The only document follows itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import order_cuts, range_group, spread, texts_of

#: Cells of each of the three sub-tables of a fingerprint, and of a part of a larger sketch.
CELLS, PART_CELLS = 8, 24

#: Digests for each part of a larger sketch, and how often a part is tried.
PER_PART, RETRIES = 24, 3

ROUNDS = 12


def pieces(text: Column, level: Column) -> Column:
    """Digests of the distinct pieces at a level: lines, cut every 2 ** level characters."""
    found = F.regexp_extract_all(text, F.concat(F.lit(r"([^\n]{1,"), F.call_function("shiftleft", F.lit(1), level).cast("string"), F.lit("})")), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def level_of(n_chars: Column) -> Column:
    """Piece lengths of 4, 8, 16, ... characters, about 8 to 16 to a text."""
    return F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(n_chars, F.lit(1)) / 16)).cast("int"))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(key: Column, cells: int, salt: int) -> Column:
    """The cell of a digest in each of the three sub-tables, from one hash."""
    h = F.xxhash64(key, F.lit(salt))
    return F.array(*[F.pmod(F.shiftrightunsigned(h, 20 * t), F.lit(cells)).cast("int") + t * cells for t in range(3)])


def sketch(keys: Column, cells: int, salt: int) -> Column:
    """Cells of three sub-tables one after the other, as structs of count, key and check."""
    none = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    placed = F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("h"), _places(k, cells, salt).alias("p")))

    def add(a: Column, u: Column) -> Column:
        return F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(u["k"]).alias("k"), a["h"].bitwiseXOR(u["h"]).alias("h"))

    def table(us: Column, t: int) -> Column:
        return F.transform(F.sequence(F.lit(t * cells), F.lit(t * cells + cells - 1)), lambda i: F.aggregate(us, none, lambda a, u: F.when(F.get(u["p"], F.lit(t)) == i, add(a, u)).otherwise(a)))

    return _let(placed, lambda us: F.concat(*[table(us, t) for t in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells_left: Column, cells: int, salt: int) -> Column:
    """(cells, found): digests that could be taken out, with +1 or -1 for the side that has them."""
    kind = "array<struct<k:bigint,s:int>>"
    start = F.struct(cells_left.alias("cells"), F.array().cast(kind).alias("found"), F.lit(False).alias("stuck"))

    def round_(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == _check(x["k"])))
        distinct = F.array_distinct(F.transform(pure, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("s"))))
        placed = F.transform(distinct, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), _check(x["k"]).alias("h"), _places(x["k"], cells, salt).alias("p")))

        def less(x: Column, i: Column, new: Column) -> Column:
            def take(a: Column, u: Column) -> Column:
                return F.struct((a["c"] - u["s"]).alias("c"), a["k"].bitwiseXOR(u["k"]).alias("k"), a["h"].bitwiseXOR(u["h"]).alias("h"))

            return F.aggregate(new, x, lambda a, u: F.when(F.array_contains(u["p"], i), take(a, u)).otherwise(a))

        def after(new: Column) -> Column:
            found = F.transform(new, lambda u: F.struct(u["k"].alias("k"), u["s"].alias("s")))
            moved = F.struct(F.transform(state["cells"], lambda x, i: less(x, i, new)).alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(False).alias("stuck"))
            return F.when(F.size(new) > 0, moved).otherwise(F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("stuck")))

        return F.when(state["stuck"], state).otherwise(_let(placed, after))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def _complete(peeled: Column) -> Column:
    return ~F.exists(peeled["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0))


def differences(a: Column, b: Column, first: Column) -> Column:
    """Digests that only one of the sets ``a`` and ``b`` has, as (key, side); ``first`` is the difference of their fingerprints."""
    kind = "array<struct<k:bigint,s:int>>"
    parts = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / PER_PART).cast("int"))

    def found(peeled: Column) -> Column:
        return _let(peeled, lambda p: F.when(_complete(p), p["found"])).cast(kind)

    def only(mine: Column, other: Column, side: int) -> Column:
        return F.transform(F.array_except(mine, other), lambda k: F.struct(k.alias("k"), F.lit(side).alias("s")))

    def part(p: Column) -> Column:
        def own(keys: Column) -> Column:
            return F.filter(keys, lambda k: F.pmod(F.xxhash64(k, F.lit("part")), parts).cast("int") == p)

        def tries(two: Column) -> Column:
            sized = ((PART_CELLS << turn, turn + 1) for turn in range(RETRIES))
            peeled = (found(peel(subtract(sketch(two["a"], cells, salt), sketch(two["b"], cells, salt)), cells, salt)) for cells, salt in sized)
            return F.coalesce(*peeled, F.concat(only(two["a"], two["b"], 1), only(two["b"], two["a"], -1)).cast(kind))

        return _let(F.struct(own(a).alias("a"), own(b).alias("b")), tries)

    larger = F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), part))
    return F.coalesce(found(peel(first, CELLS, 0)), larger)


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Jaccard likeness of two digest sets from their sizes and what peeling found."""
    both = (F.size(a) + F.size(b) - F.size(found)) / 2
    union = (F.size(a) + F.size(b) + F.size(found)) / 2
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both / union)))


def as_text(level: Column, *sketches: Column) -> Column:
    """A fingerprint as text: the level, then two hex digits of count, sixteen of key and eight of check for each cell."""

    def digits(x: Column) -> Column:
        return F.concat(F.lpad(F.hex(F.pmod(x["c"], F.lit(256))), 2, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.substring(F.lpad(F.hex(x["h"]), 16, "0"), 9, 8))

    return F.lower(F.concat(level.cast("string"), *(F.concat(F.lit(":"), F.array_join(F.transform(s, digits), "")) for s in sketches)))


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each text and the one after it in order of id, the first after the last.

    Documents go to ranges of ids; a range also gets the first document of the
    next one, which is known from the cuts, so each text is shuffled once.
    """
    texts = texts_of(docs)
    spark = docs.sparkSession
    cuts = order_cuts(texts, "doc_id", 4 * spread(spark))
    least = texts.agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("m")).first()["m"]
    low = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    group = range_group(F.col("doc_id"), cuts)
    last = len(cuts)
    heads = ", ".join(f"{c}L" for c in cuts)
    goes = F.array(F.struct(group.alias("g"), F.lit(0).alias("ghost")))
    if cuts:
        goes = F.when(F.expr(f"doc_id IN ({heads})"), F.concat(goes, F.array(F.struct((group - 1).alias("g"), F.lit(1).alias("ghost"))))).otherwise(goes)
    if least is not None:
        goes = F.when(low == F.lit(least), F.concat(goes, F.array(F.struct(F.lit(last).alias("g"), F.lit(2).alias("ghost"))))).otherwise(goes)
    dealt = texts.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.inline(goes))
    by_range = Window.partitionBy("g").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "_h")
    seen = dealt.repartition(spread(spark), "g").select("g", "ghost", "doc_id", "_h", "text", F.lead("text").over(by_range).alias("next_text"))
    return seen.where("ghost = 0").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_edited_differences).

    ``near_*`` are likenesses (0 to 1) from the peeled differences of the
    fingerprints of a text and of its edited form or of the next text.
    """
    base = followed(docs).withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    names = {"a": "text", "e": "_edited", "n": "next_text"}
    levels = base.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), *names.values(), *(level_of(F.char_length(c)).alias(f"{k}_level") for k, c in names.items()))
    # of texts with distant levels, the pieces of the shorter one at the level of the longer one
    mine, theirs = F.col("a_level"), F.col("n_level")
    far = F.when(mine > theirs + 1, pieces(F.col("next_text"), mine)).when(theirs > mine + 1, pieces(F.col("text"), theirs))
    sets = levels.select("doc_id", "n_chars", "edited_sha256", *(f"{k}_level" for k in names), *(pieces(F.col(c), F.col(f"{k}_level") + up).alias(f"{k}{up}") for k, c in names.items() for up in (0, 1)), far.alias("far"))
    tables = sets.select("*", sketch(F.col("far"), CELLS, 0).alias("far_cells"), *(sketch(F.col(f"{k}{up}"), CELLS, 0).alias(f"{k}{up}_cells") for k in names for up in (0, 1)))

    def compared(other: str) -> Column:
        """Struct of both sets and the fingerprints' difference at the level that both have."""
        ways = None
        for up, down in ((0, 0), (1, 0), (0, 1)):
            same = F.col("a_level") + up == F.col(f"{other}_level") + down
            pair = F.struct(F.col(f"a{up}").alias("a"), F.col(f"{other}{down}").alias("b"), subtract(F.col(f"a{up}_cells"), F.col(f"{other}{down}_cells")).alias("d"))
            ways = F.when(same, pair) if ways is None else ways.when(same, pair)
        if other == "n":
            for longer, a, b in ((mine > theirs + 1, "a0", "far"), (theirs > mine + 1, "far", "n0")):
                ways = ways.when(longer, F.struct(F.col(a).alias("a"), F.col(b).alias("b"), subtract(F.col(f"{a}_cells"), F.col(f"{b}_cells")).alias("d")))
        return ways

    pairs = tables.select("*", compared("e").alias("_e"), compared("n").alias("_n"))
    found = pairs.select("*", differences(F.col("_e.a"), F.col("_e.b"), F.col("_e.d")).alias("_ef"), differences(F.col("_n.a"), F.col("_n.b"), F.col("_n.d")).alias("_nf"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("a_level"), F.col("a0_cells"), F.col("a1_cells")).alias("fingerprint"),
        as_text(F.col("e_level"), F.col("e0_cells"), F.col("e1_cells")).alias("edited_fingerprint"),
        *(F.when(F.col(p).isNull() | F.col(f).isNull(), F.lit(0.0)).otherwise(likeness(F.col(f"{p}.a"), F.col(f"{p}.b"), F.col(f))).alias(out) for p, f, out in (("_e", "_ef", "near_edited"), ("_n", "_nf", "near_next"))),
        F.coalesce(F.size("_ef"), F.lit(-1)).alias("n_edited_differences"),
    )
