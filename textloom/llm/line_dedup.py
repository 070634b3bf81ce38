"""Line deduplication by a segment-partition edit join, in DataFrame and SQL functions alone.

Two lines within d edits, cut into d + 1 segments, share one segment unchanged at a nearly
equal place. A line indexes its own segments by (length, segment number, content) and probes
the substrings that could be a segment of a line up to d characters shorter: for each
length and segment only the few places that a smallest alignment leaves. What meets is
verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._spark import keyed, plain, written

EDITS = 2
#: Shorter lines are compared as they stand, for exact copies only, and empty ones not at all.
MIN_CHARS = 20
#: Keys up to this number may be broadcast (8 or 16 bytes each and what a hash table adds); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Lines with a segment in common that meet in one task's block; more are dealt out in squares of such blocks.
SQUARE = 2000


def probes(edits: int = EDITS) -> str:
    """SQL for the array of (less, i, move, own): segment i of lines `less` characters shorter, looked for `move` further on.

    less = move = 0 are the line's own segments.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                out.append(f"named_struct('less', {less}, 'i', {i}, 'move', {move}, 'own', {1 if less == move == 0 else 0})")
    return f"array({', '.join(out)})"


def marked(every: DataFrame, edits: int = EDITS) -> DataFrame:
    """lid, more, key, own of each probe of rows (lid, more, len, line); lines themselves go no further.

    The lines are cut in UTF-32, where a substring is found without going through the
    characters before it. Segments are even parts, the longer ones last. One small
    expression a probe, after the array is taken apart: a large one would not be compiled.
    """
    parts = edits + 1
    each = every.select("lid", "more", "len", F.encode("line", "UTF-32").alias("wide")).select("lid", "more", "wide", "len", F.explode(F.expr(probes(edits))).alias("p"))
    each = each.select("lid", "more", "wide", F.expr("len - p.less").alias("size"), "p.i", "p.move", "p.own")
    each = each.selectExpr("lid", "more", "wide", "size", "i", "move", "own", f"cast(size div {parts} as int) as base", f"i - {parts} + size % {parts} as late")
    begin = "i * base + greatest(0, late) + move"
    key = f"xxhash64(size, i, substring(wide, 4 * ({begin}) + 1, 4 * (base + if(late >= 0, 1, 0))))"
    return each.selectExpr("lid", "more", f"{key} as key", "own")


def edit_distance(a: str, b: str, edits: int = EDITS) -> str:
    """SQL for the edit distance of two lines, exact if it is `edits` or less and over `edits` otherwise.

    a and b are arrays of characters whose sizes differ by `edits` at most and are over
    2 * edits. Bit t of each vector is row j - edits + t of column j: a band of 2 * edits + 1
    rows that moves down by one a column (bit-vectors of vertical and horizontal steps).
    """
    w = 2 * edits + 1
    mask, top = (1 << w) - 1, 1 << (2 * edits)
    match = " + ".join(f"if(coalesce(get({a}, j - {edits + 1} + {t}) = get({b}, j - 1), false), {1 << t}, 0)" for t in range(w))
    hp, hn = f"((s.vn | ~(d | s.vp)) & {mask})", "(d & s.vp)"
    row = f"(size({a}) - j + {edits})"
    step = f"""named_struct(
        'vp', ({hn} | ~(shiftright(d, 1) | {hp})) & {mask},
        'vn', shiftright(d, 1) & {hp},
        'far', s.far + if(j <= size({a}) - {edits}, if(d & {top} = 0, 1, 0), (shiftright({hp}, {row}) & 1) - (shiftright({hn}, {row}) & 1)))"""
    diagonal = f"((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {mask}"
    let = f"element_at(transform(transform(array({match}), x -> {diagonal}), d -> {step}), 1)"
    first = ((1 << (edits + 1)) - 1) << edits
    return f"aggregate(sequence(1, size({b})), named_struct('vp', {first}, 'vn', 0, 'far', {edits}), (s, j) -> {let}, s -> s.far)"


_DIGITS = 15
_MASK = (1 << 4 * _DIGITS) - 1


def histogram(line: str) -> str:
    """SQL for the counts of a line's characters by their code modulo 15, as digits to base 16 of one number modulo 2**60."""
    return f"aggregate(split({line}, ''), 0L, (s, c) -> (s + shiftleft(1L, 4 * (ascii(c) % {_DIGITS}))) & {_MASK}L)"


def apart(a: str, b: str) -> str:
    """SQL for the difference of two histograms: an edit changes it by 2 at most, a pair within 7 edits has its true difference."""
    biased = f"(({a} - {b} + {_MASK // 15 * 7}L) & {_MASK}L)"
    return " + ".join(f"abs((shiftright({biased}, {4 * i}) & 15) - 7)" for i in range(_DIGITS))


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", row: str = "row") -> DataFrame:
    """doc_id, row, pos, line of every line; null and empty texts have none."""
    whole = docs.select(F.col(doc).alias("doc_id"), F.col(row).alias("row"), F.col(text).cast("string").alias("whole")).where("whole != ''")
    return whole.select("doc_id", "row", F.posexplode(F.split("whole", "\n")).alias("pos", "line"))


def _named(each: DataFrame, min_chars: int) -> DataFrame:
    """Lines of min_chars or more with len and the two halves of their 128-bit name, lid and more."""
    return each.withColumn("len", F.length("line")).where(F.col("len") >= min_chars).withColumn("lid", F.xxhash64("line", "len")).withColumn("more", F.xxhash64(F.lit(1), "line"))


def _only(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are among those of the written keys; broadcast only if they are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, columns, "left_semi")


_NAME = ["lid", "more"]


def _met(shared: DataFrame) -> DataFrame:
    """The pairs of different lines (a, b: struct of name and histogram) that share a key of rows (key, lid, more, h, own), one of them its own.

    Of a key with many lines, the lines are dealt to blocks, and each pair of blocks meets by
    itself, so that no task has more than SQUARE by SQUARE pairs of a key at once.
    """
    blocks = shared.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SQUARE).cast("int").alias("blocks"))
    dealt = shared.join(blocks, "key").withColumn("block", F.pmod("more", F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda x: F.struct("lid", "more", "h").alias(x)
    left = dealt.where("own = 1").select("key", "block", others.alias("other"), side("a"))
    right = dealt.select("key", others.alias("block"), F.col("block").alias("other"), side("b"))
    return left.join(right, ["key", "block", "other"]).where("a.lid != b.lid or a.more != b.more")


def judge(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, doc: str = "doc_id", text: str = "text", short: bool = False, row: str = "row") -> DataFrame:
    """lid, more, len, doc_id, row, pos, copies, near of each distinct line of min_chars characters or more; with short, of all that are not empty.

    docs has a key of its rows. doc_id, row and pos are a line's first occurrence (smallest id, null ids before all, then row, then place); copies the number of
    occurrences; near: an earlier line is within the edits. The relation is not closed under
    chains: a line counts against later ones even if it goes itself.
    """
    if min_chars < 2 * edits + 2 or edits > 7:
        raise ValueError("min_chars has to be over twice the edits and one, and edits 7 at most")
    every = _named(lines(docs, doc, text, row), min_chars)
    firsts = (_named(lines(docs, doc, text, row), 1) if short else every).groupBy(*_NAME, "len").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = written(firsts.select(*_NAME, "len", "first.*", "copies"), "lines")
    marks = marked(every, edits)
    # Nearly all keys belong to one line; they end here, with copies folded before the shuffle.
    met = marks.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high"), F.max("own").alias("own"))
    met = written(met.where("low != high and own = 1").select("key"), "line-keys")
    shared = written(_only(marks, met, ["key"]).distinct(), "line-marks")
    # The lines that share a key, once each, with the histograms that leave out most pairs that are alike but for a word.
    names = written(shared.select(*_NAME).distinct(), "line-names")
    texts = _only(every, names, _NAME).groupBy(*_NAME).agg(F.any_value("line").alias("line"))
    texts = written(texts.withColumn("h", F.expr(histogram("line"))), "line-texts")
    pairs = _met(shared.join(texts.select(*_NAME, "h"), _NAME)).where(F.expr(apart("a.h", "b.h")) <= 2 * edits)
    one, two = F.struct("a.lid", "a.more"), F.struct("b.lid", "b.more")
    pairs = written(pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct().select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in _NAME]), "line-pairs")
    at = lambda x: texts.join(firsts, _NAME).select(F.col("lid").alias(f"lid_{x}"), F.col("more").alias(f"more_{x}"), F.struct("doc_id", "row", "pos").alias(f"at_{x}"), F.split("line", "").alias(f"line_{x}"))
    both = pairs.join(at("a"), ["lid_a", "more_a"]).join(at("b"), ["lid_b", "more_b"])
    close = both.where(f"abs(size(line_a) - size(line_b)) <= {edits}").where(F.expr(edit_distance("line_a", "line_b", edits)) <= edits)
    later = close.select(*[F.when(F.col("at_a") < F.col("at_b"), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(c) for c in _NAME])
    return firsts.join(later.distinct().withColumn("near", F.lit(True)), _NAME, "left").select(*_NAME, "len", "doc_id", "row", "pos", "copies", F.coalesce("near", F.lit(False)).alias("near"))


def dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, doc: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """The documents, all columns, their texts without the repeated lines; a text of which nothing is left is empty.

    A line stays where it stands first (smallest id, null ids before all; of rows that share an id, in the order in which
    they are read), unless an earlier line is near. Null texts stay null. The order of the lines stays, and so do empty lines; lines under
    min_chars go if they are exact copies and short is set, and stay otherwise.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, own = keyed(plain(docs)), names[docs.columns.index(text)]
    judged = judge(rows, edits, min_chars, names[docs.columns.index(doc)], own, short)
    kept = judged.where("not near").groupBy("row").agg(F.collect_set("pos").alias("places"))
    # Texts are dealt out once, and not sorted: each task holds its part of the places.
    both = rows.join(kept.hint("shuffle_hash"), "row", "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    return without(both, own, 1 if short else min_chars).select(*names).toDF(*docs.columns)


def without(rows: DataFrame, text: str, judged: int) -> DataFrame:
    """rows (places, text) with the lines at the places and those of under `judged` characters, in their order: no line is looked for among the places."""
    never = f"filter(sequence(0, size(all) - 1), i -> length(all[i]) < {judged})"
    return rows.withColumn(text, F.expr(f"transform(array(split(cast({text} as string), '\\n')), all -> array_join(transform(array_sort(concat(places, {never})), i -> all[i]), '\\n'))[0]"))


def digest(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, doc: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_long, n_copies, n_near, kept_chars of each row; rows that share an id are apart, as in dedup().

    n_long: lines of min_chars or more; n_copies: those that are not the first of their kind,
    with short also lines under min_chars that are not empty;
    n_near: firsts with an earlier near line; kept_chars: characters of the long lines that stay.
    """
    rows = keyed(docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")))
    judged = written(judge(rows, edits, min_chars, short=short), "line-verdicts")
    # Only first occurrences can stay, and each stands in judged with its place.
    stay = judged.groupBy("row").agg(F.count(F.lit(1)).alias("firsts"), F.count(F.when(F.col("near"), 1)).alias("n_near"), F.sum(F.when(~F.col("near") & (F.col("len") >= min_chars), F.col("len")).otherwise(0)).alias("kept_chars"))
    sizes = rows.select("doc_id", "row", F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.split("text", "\n")).otherwise(F.array().cast("array<string>")).alias("all"))
    sizes = sizes.select("doc_id", "row", F.size("all").cast("long").alias("n_lines"), F.expr(f"cast(size(filter(all, x -> length(x) >= {min_chars})) as long)").alias("n_long"), F.expr(f"cast(size(filter(all, x -> length(x) >= {1 if short else min_chars})) as long)").alias("n_judged"))
    both = sizes.join(stay, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select("doc_id", "n_lines", "n_long", (F.col("n_judged") - zero("firsts")).alias("n_copies"), zero("n_near").alias("n_near"), zero("kept_chars").alias("kept_chars"))
