"""Line de-duplication: exact first occurrences, then a segment-partition edit join of the distinct lines.

Two lines within ``distance`` edits of each other agree on at least one of ``distance + 1`` segments into
which the shorter one is split evenly, at a place that the lengths bound. So every distinct line is indexed
by its segments, and probes, for its own and each smaller length in reach, the substrings that could equal a
segment there. Short lines take part with one edit, so with two segments; of a line of one character, one of
them is empty and meets all lines that are as short. Lines that meet must also nearly agree in the counts of
some letters, as near lines do; the join itself checks that.

A segment that many different lines share (a common passage, a template) makes no pairs: see ``crowd_pairs``. Its
lines are told apart by what is rare in them.

Verification cuts what two lines have in common at both ends and follows the few edit scripts that are left; each
of them ends in comparing pieces for equality, so a pair costs time in proportion to its length. That is not a
bit-parallel matrix: column functions could run one only character by character in interpreted lambdas.

The main path is DataFrame functions throughout. Lines are grouped by hash, so a line that is in every
document is one row of the join; the join sees distinct lines only.
"""

from __future__ import annotations

import functools
import json
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import skew_join, written


#: Bins in which grams are counted: a bound of what is collected and of the table that ranks them.
GRAM_BINS = 1 << 14
#: Line ids up to which they are sent to all executors; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class LineConfig:
    """``distance`` is the largest number of edits between near copies. If the shorter of two lines has fewer
    than ``least_chars`` characters it is 1 at most: among short ones a few edits make another line. Segments
    that more than ``few`` lines have are joined another way, with the same result: by grams of ``gram`` characters
    (``short_gram`` in short lines), of which those that more than ``common`` lines have make no pairs.
    """

    distance: int = 2
    least_chars: int = 40
    few: int = 16
    gram: int = 4
    short_gram: int = 3
    common: int = 64

    @property
    def short_distance(self) -> int:
        return min(1, self.distance)


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, at, line`` of every line with a visible character; ``at`` counts from 0."""
    split = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    return docs.select("doc_id", F.posexplode(split).alias("at", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def line_key(line: str = "line") -> Column:
    """The first 128 bits of a line's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.col(line), 256)), 1, 16)


#: Frequent letters whose counts two near lines must nearly share. Any set keeps the result right.
LETTERS = "etanirso"


def _letter_counts() -> Column:
    """Counts of ``LETTERS`` in a line, a byte each, 255 at most."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(F.least(n, F.lit(255)).cast("long"), 8 * i))
    return out


def _counts_differ(one: str, two: str) -> Column:
    """Sum of the differences of two lines' letter counts; each edit adds at most 2."""
    byte = lambda c, i: F.shiftrightunsigned(F.col(c), 8 * i).bitwiseAND(F.lit(255))
    return sum((F.abs(byte(one, i) - byte(two, i)) for i in range(1, len(LETTERS))), F.abs(byte(one, 0) - byte(two, 0)))


def _places(distance: int, own: bool) -> Column:
    """Where to cut segments, as ``(parts, k, shorter, move)``: of the line itself (``own``), or wherever in it
    a segment of a line that is at most ``distance`` shorter may lie.

    Segment k of the shorter line may be moved by as many places as the edits before it allow (k of them),
    and as those after it do (distance - k, given the difference of lengths).
    """
    parts = distance + 1
    places = []
    for shorter in range(1 if own else parts):
        for k in range(parts):
            moves = (0,) if own else range(max(-k, shorter - (distance - k)), min(k, shorter + (distance - k)) + 1)
            places += [(parts, k, shorter, move) for move in moves]
    names = ("parts", "k", "shorter", "move")
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, names, strict=True))) for p in places))


def _keys(lines: DataFrame, places: Column, *keep: str) -> DataFrame:
    """``keep`` and one row per place that lies inside the line: ``probe``, the hash of the segment there.

    Lines of one byte a character are cut by bytes, others by characters; equal pieces hash alike.
    """
    length = F.col("length") - F.col("p.shorter")
    size = F.floor(length / F.col("p.parts")).cast("int")
    longer = length - size * F.col("p.parts")  # so many of the last segments are a character longer
    ahead = F.greatest(F.lit(0), F.col("p.k") + longer - F.col("p.parts"))
    cut = lines.select("*", F.explode(places).alias("p")).select(
        *keep,
        "line",
        "length",
        F.col("p.k").alias("k"),
        length.alias("of"),
        (size * F.col("p.k") + ahead + 1 + F.col("p.move")).alias("start"),
        (size + (F.col("p.k") + longer >= F.col("p.parts")).cast("int")).alias("size"),
    )
    bytewise = F.encode("line", "UTF-8").substr(F.col("start"), F.col("size"))
    piece = F.when(F.octet_length("line") == F.col("length"), bytewise).otherwise(
        F.encode(F.col("line").substr(F.col("start"), F.col("size")), "UTF-8")
    )
    inside = (F.col("of") >= 0) & (F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("length"))
    return cut.where(inside).select(*keep, F.xxhash64("k", "of", piece).alias("probe"))


def _index_places(config: LineConfig) -> Column:
    return F.when(F.col("length") >= config.least_chars, _places(config.distance, True)).otherwise(
        _places(config.short_distance, True)
    )


def _probe_places(config: LineConfig) -> Column:
    """A line of just ``least_chars`` meets lines of both kinds: as long, and shorter."""
    far, close = _places(config.distance, False), _places(config.short_distance, False)
    return (
        F.when(F.col("length") > config.least_chars, far)
        .when(F.col("length") == config.least_chars, F.concat(far, close))
        .otherwise(close)
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _common(one: Column, two: Column, most: Column, from_end: bool) -> Column:
    """How many characters, ``most`` at most, two strings share at the start or at the end: pieces of halving sizes
    are compared, so each character is compared about once.
    """

    sizes = F.transform(F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))

    def grown(found: Column, size: Column) -> Column:
        end = found + size
        start = (lambda s: F.char_length(s) - end + 1) if from_end else (lambda s: found + 1)
        return F.when((end <= most) & (one.substr(start(one), size) == two.substr(start(two), size)), end).otherwise(found)

    return F.aggregate(sizes, F.lit(0), grown)


def _cut(one: Column, two: Column) -> Column:
    """What is left of two strings, ``x`` and ``y``, without what they share at the start and then at the end."""

    def from_start(v: Column) -> Column:
        head = _common(v["x"], v["y"], F.least(F.char_length(v["x"]), F.char_length(v["y"])), False)
        return _let(head, lambda n: F.struct(_from(v["x"], n).alias("x"), _from(v["y"], n).alias("y")))

    def from_end(v: Column) -> Column:
        tail = _common(v["x"], v["y"], F.least(F.char_length(v["x"]), F.char_length(v["y"])), True)
        return _let(tail, lambda n: F.struct(_upto(v["x"], n).alias("x"), _upto(v["y"], n).alias("y")))

    return _let(_let(F.struct(one.alias("x"), two.alias("y")), from_start), from_end)


def _from(s: Column, n: Column | int) -> Column:
    return s.substr(F.lit(n) + 1 if isinstance(n, int) else n + 1, F.char_length(s))


def _upto(s: Column, n: Column | int) -> Column:
    return s.substr(F.lit(1), F.char_length(s) - n)


def within(one: Column, two: Column, edits: int) -> Column:
    """Whether two strings are at most ``edits`` edits apart.

    Once both ends are cut, the first and the last characters differ, so an edit stands at either end. With one edit
    that is the same one; with two, one at each end and all between them equal. With more, the first edit is
    tried in each of its three kinds.
    """

    def rest(v: Column) -> Column:
        x, y = v["x"], v["y"]
        n, m = F.char_length(x), F.char_length(y)
        if edits <= 1:
            return (n <= edits) & (m <= edits)
        if edits == 2:
            inner = lambda s: s.substr(F.lit(2), F.greatest(F.char_length(s) - 2, F.lit(0)))
            return (
                F.when((n <= 1) & (m <= 1), True)
                .when(n == m, (inner(x) == inner(y)) | (_from(x, 1) == _upto(y, 1)) | (_upto(x, 1) == _from(y, 1)))
                .when(n == m + 1, (m == 0) | (_from(y, 1) == inner(x)) | (_upto(y, 1) == inner(x)))
                .when(m == n + 1, (n == 0) | (_from(x, 1) == inner(y)) | (_upto(x, 1) == inner(y)))
                .when(n == m + 2, inner(x) == y)
                .when(m == n + 2, inner(y) == x)
                .otherwise(False)
            )
        first = [(_from(x, 1), _from(y, 1)), (_from(x, 1), y), (x, _from(y, 1))]
        tried = functools.reduce(operator.or_, (within(a, b, edits - 1) for a, b in first))
        return ((n <= edits) & (m <= edits)) | ((F.abs(n - m) <= edits) & (n > 0) & (m > 0) & tried)

    return _let(_cut(one, two), rest)


def _near(a: str, b: str, config: LineConfig) -> Column:
    """Whether different lines of two sets of columns are near: lengths and letter counts first, then the texts."""
    shorter = F.least(f"{a}_length", f"{b}_length")
    long = shorter >= config.least_chars
    allowed = F.when(long, config.distance).otherwise(config.short_distance)
    alike = (F.abs(F.col(f"{a}_length") - F.col(f"{b}_length")) <= allowed) & (_counts_differ(f"{a}_counts", f"{b}_counts") <= 2 * allowed)
    one, two = F.col(f"{a}_line"), F.col(f"{b}_line")
    return alike & (one != two) & F.when(long, within(one, two, config.distance)).otherwise(within(one, two, config.short_distance))


def _named(lines: DataFrame, prefix: str) -> DataFrame:
    return lines.select(*(F.col(c).alias(f"{prefix}_{c}") for c in lines.columns))


def sized(lines: DataFrame) -> DataFrame:
    """``lines`` with what the join looks at first: ``length`` in characters and letter ``counts``."""
    return lines.withColumn("length", F.char_length("line")).withColumn("counts", _letter_counts())


def late_lines(lines: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``(line_id, place, line, length, counts)``, one row per distinct line, to the ``line_id`` of every line
    that is near one with a smaller ``place``. Places are distinct. Null lines are near nothing.

    A segment that few lines have makes pairs, whose texts are fetched and verified. For one that many have,
    the join only notes who has it, and ``crowd_pairs`` goes on with these lines.
    """
    lines = lines.where("line is not null")
    index = _keys(lines, _index_places(config), "line_id", "length", "counts").withColumnsRenamed(
        {"line_id": "one", "length": "one_length", "counts": "one_counts"}
    )
    probes = _keys(lines, _probe_places(config), "line_id", "counts").withColumnsRenamed({"line_id": "two", "counts": "two_counts"})
    # written first, so that while they are few the index need not be moved to leave them out
    crowded = written(index.groupBy("probe").agg(F.count("*").alias("members")).where(F.col("members") > config.few).select("probe"), "line-segments")
    none = [F.lit(None).cast("long").alias(c) for c in ("one", "one_counts")]
    marks = index.join(crowded, "probe", "left_anti").unionByName(crowded.select("probe", *none, F.lit(None).cast("int").alias("one_length")))
    reach = F.when(F.col("one_length") >= config.least_chars, 2 * config.distance).otherwise(2 * config.short_distance)
    pair = (F.col("one") != F.col("two")) & (_counts_differ("one_counts", "two_counts") <= reach)
    met = marks.join(probes, "probe").where(F.col("one").isNull() | pair)
    met = written(
        met.select(
            F.when(F.col("one").isNull(), F.col("probe")).alias("crowd"),
            F.least("one", "two").alias("a"),
            F.greatest("one", "two").alias("b"),
        ),
        "line-candidates",
    )
    pairs = met.where("crowd is null").select("a", "b").distinct()
    crowds = met.where("crowd is not null").select("crowd", F.col("b").alias("line_id")).distinct()

    # only lines that met another are fetched; while these are few, without moving the others
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("line_id")).union(crowds.select("line_id")).distinct(), "line-ids")
    few = ids.count() <= BROADCAST_ROWS
    texts = written(lines.join(F.broadcast(ids) if few else ids, "line_id", "left_semi"), "line-texts")
    late = verified(pairs, texts, config)
    crowd = written(texts.join(crowds.select("line_id").distinct(), "line_id", "left_semi"), "line-crowds")
    if not crowd.isEmpty():
        late = late.union(crowd_pairs(crowd, config)).union(small_crowds(crowd, crowds, config))
    return late.distinct()


def verified(pairs: DataFrame, texts: DataFrame, config: LineConfig) -> DataFrame:
    """``(a, b)`` pairs of line ids -> the later line of each near pair."""
    both = pairs.join(_named(texts, "a"), F.col("a") == F.col("a_line_id")).join(_named(texts, "b"), F.col("b") == F.col("b_line_id"))
    later = F.when(F.col("a_place") < F.col("b_place"), F.col("b")).otherwise(F.col("a"))
    return both.where(_near("a", "b", config)).select(later.alias("line_id"))


def _kinds(config: LineConfig) -> list[tuple[int, int, Column]]:
    """``(edits, gram width, which lines)`` of long and of short lines; lines of just ``least_chars`` are both."""
    return [
        (config.distance, config.gram, F.col("length") >= config.least_chars),
        (config.short_distance, config.short_gram, F.col("length") <= config.least_chars),
    ]


def rare_grams(lines: DataFrame, edits: int, width: int) -> DataFrame:
    """``line_id, gram`` of the ``width * edits + 1`` rarest grams (runs of ``width`` characters) of each line that has
    as many, in one order for all lines.

    ``edits`` edits break at most ``width * edits`` grams of a line, so near lines keep all others in common, and one of
    them is among these of both. Any order of grams is right; this one is by how many grams of all lines share a gram's bin.
    There are ``GRAM_BINS`` bins however many lines there are, so that a line ranks its grams by itself.
    """
    keep = width * edits + 1
    chars = F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0))
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - width), lambda i: F.xxhash64(*(F.get(c, i + k) for k in range(width))))
    dealt = lines.where(F.col("length") >= keep + width - 1).hint("rebalance")  # a line has as many grams as characters
    grams = dealt.select("line_id", _let(chars, cut).alias("grams"))
    bin_of = lambda g: F.pmod(g, F.lit(GRAM_BINS)).cast("int")
    counts = grams.select(F.explode("grams").alias("gram")).groupBy(bin_of(F.col("gram")).alias("bin")).agg(F.count("*").alias("n"))
    uses = dict.fromkeys(range(GRAM_BINS), 0) | {r["bin"]: r["n"] for r in counts.collect()}
    table = F.from_json(F.lit(json.dumps([uses[i] for i in range(GRAM_BINS)])), "array<long>")
    ranked = F.array_sort(F.transform("grams", lambda g: F.struct(F.get(table, bin_of(g)).alias("uses"), g.alias("gram"))))
    rarest = F.array_distinct(F.transform(F.slice(ranked, 1, keep), lambda r: r["gram"]))
    return grams.select("line_id", F.explode(rarest).alias("gram"))


def crowd_pairs(crowd: DataFrame, config: LineConfig) -> DataFrame:
    """Lines of crowded segments -> ``line_id`` of those near one with a smaller place; but see ``small_crowds``.

    Lines of one template share most of their segments, so they are joined by what is rarest in them. A gram
    that is rare makes pairs. One that is still common, as where all lines differ in a few digits only, makes none: its
    lines meet with their texts in a semi-join that stops at the first earlier near line.
    """
    found = None
    for edits, width, which in _kinds(config):
        lines = crowd.where(which)
        grams = written(rare_grams(lines, edits, width), "line-rare")
        sizes = grams.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
        shared = written(skew_join(grams, sizes, "gram"), "line-shared")
        some = shared.where(F.col("members") <= config.common).select("gram", "line_id")
        some = skew_join(some, lines.select("line_id", "length", "counts"), "line_id").select("gram", F.col("line_id").alias("a"), F.col("length").alias("al"), F.col("counts").alias("ac"))
        other = some.select("gram", F.col("a").alias("b"), F.col("al").alias("bl"), F.col("ac").alias("bc"))
        alike = (F.col("a") < F.col("b")) & (F.abs(F.col("al") - F.col("bl")) <= edits) & (_counts_differ("ac", "bc") <= 2 * edits)
        pairs = written(some.join(other, "gram").where(alike).select("a", "b").distinct(), "line-pairs")
        many = skew_join(shared.where(F.col("members") > config.common).select("gram", "line_id"), lines, "line_id")
        part = verified(pairs, lines, config).union(_semi(many, "gram", config))
        found = part if found is None else found.union(part)
    return found


def _semi(rows: DataFrame, key: str, config: LineConfig, *also: Column) -> DataFrame:
    """``line_id`` of the rows that are near one of the same key with a smaller place."""
    rows = written(rows.withColumn("spread", F.xxhash64(key)), "line-semi")
    one, two = _named(rows, "one"), _named(rows, "two")
    meets = (
        (F.col("one_spread") == F.col("two_spread"))  # a second key, so that a hot one may be split
        & (F.col(f"one_{key}") == F.col(f"two_{key}"))
        & (F.col("one_place") < F.col("two_place"))
    )
    for condition in also:
        meets = meets & condition
    return two.join(one, meets & _near("one", "two", config), "left_semi").select(F.col("two_line_id").alias("line_id"))


def small_crowds(crowd: DataFrame, crowds: DataFrame, config: LineConfig) -> DataFrame:
    """Near lines one of which is too short to have enough grams: these meet by their crowded segments."""
    small = F.lit(False)
    for edits, width, which in _kinds(config):
        small = small | (which & (F.col("length") < width * (edits + 1) + edits))
    lines = crowd.where(small)
    # a line is in a crowd by a segment of its own, or by what may be one of a shorter line
    own = _keys(lines, _index_places(config), "line_id").select(F.col("probe").alias("crowd"), "line_id", F.lit(True).alias("own"))
    members = crowds.join(own.distinct(), ["crowd", "line_id"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    return _semi(members.join(lines, "line_id"), "crowd", config, F.col("one_own") | F.col("two_own"))


def line_verdicts(docs: DataFrame, config: LineConfig = LineConfig()) -> tuple[DataFrame, DataFrame]:
    """Distinct lines with the place of their first occurrence and whether they are near copies, and all
    occurrences.

    A distinct line is a near copy if a near one occurs first, in (doc_id, at) order; of lines at one place,
    as rows that share a doc_id have them, the one with the smaller hash counts as first.
    """
    occurrences = lines_of(docs.where("doc_id is not null").select("doc_id", "text"))
    grouped = occurrences.groupBy(line_key().alias("key")).agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("uses"), F.first("line").alias("line")
    )
    place = F.struct("first.doc_id", "first.at", "key").alias("place")
    first = written(sized(grouped.select(F.monotonically_increasing_id().alias("line_id"), place, "uses", "line")), "lines")
    late = late_lines(first.select("line_id", "place", "line", "length", "counts"), config)
    verdicts = first.select("line_id", F.col("place").alias("first"), "uses").join(late.withColumn("near", F.lit(True)), "line_id", "left")
    return verdicts, occurrences


def line_report(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``(doc_id, text)`` -> ``doc_id, n_lines, n_exact, n_near, n_kept`` per doc_id.

    ``n_lines`` counts lines with a visible character. A line is an exact copy if an equal one occurs earlier
    (smaller doc_id, or the same document above); the first of equal lines is a near copy if an earlier line
    differs by 1 to ``distance`` edits, or by 1 if either has fewer than ``least_chars`` characters; every other
    line is kept. Null and empty texts have no lines; rows
    without doc_id are left out; rows that share a doc_id are one document. No rows give no rows.
    """
    verdicts, occurrences = line_verdicts(docs, config)
    # every occurrence counts as a line; what is not a first occurrence is an exact copy
    lines = occurrences.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    firsts = verdicts.groupBy(F.col("first.doc_id").alias("doc_id")).agg(
        F.count("*").alias("n_first"), F.count_if(F.coalesce("near", F.lit(False))).alias("n_near")
    )
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        ids.join(lines, "doc_id", "left")
        .join(firsts, "doc_id", "left")
        .select(
            "doc_id",
            zero("n_lines").alias("n_lines"),
            (zero("n_lines") - zero("n_first")).alias("n_exact"),
            zero("n_near").alias("n_near"),
            (zero("n_first") - zero("n_near")).alias("n_kept"),
        )
    )


def dedup_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``(doc_id, text)`` -> ``doc_id, text`` with exact and near copies of earlier lines removed.

    Lines without a visible character are dropped. A document that keeps no line has the empty text.
    """
    verdicts, _ = line_verdicts(docs, config)
    kept = verdicts.where("near is null").select("first.doc_id", "first.at", "first.key")
    rows = lines_of(docs.where("doc_id is not null").select("doc_id", "text")).withColumn("key", line_key())
    texts = (
        rows.distinct()
        .join(kept, ["doc_id", "at", "key"])
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
        .select("doc_id", F.array_join("lines.line", "\n").alias("text"))
    )
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    return ids.join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
