"""Texts cut off by a field limit or a broken transfer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import bounded_broadcast, materialize

#: A length is a spike if so many times as many texts have it as have a length in the tenth below or above it, on average, ...
SPIKE_RATIO = 6.0
#: (a tenth of the length and of so much, that short lengths have neighbours) ...
SHORT = 20
#: ... and if chance would make such a length, in any of a histogram's lengths, no more often than this.
SPIKE_CHANCE = 1e-6
#: An opening of lines is learned from the last lines of at least so many pages, and this share of them, ...
OPENING_PAGES, OPENING_SHARE = 3, 0.0002
#: ... if it stands at the start of a line wherever it is met, but for this part, ...
STANDS_ALONE = 0.8
#: ... and its lines end a page at least this many times as often as any line does.
ENDS_PAGES = 0.5
#: One letter in so many of an opening may be misread.
OPENING_LETTERS = 5

#: A signature after a dash.
_SIGNED = r"^[—–-]\s*\p{L}"
#: Lines, and the lines of columns that were joined in one.
_PIECES = r"\r?\n|\t|\||\s{3,}"
_BROKEN = r"(\p{L})[-=¬\x{AD}‐][ \t]*\r?\n\s*"
_MARK = r"(\[\.\.\.\]|\[…\]|…|\.\.\.|\x{FFFD})\s*$"
_TERMINAL = r"[.!?·]\p{Z}*[\"»”“’')\]]*\s*$"
#: A comma at the end is most often a misread stop, so it is no evidence of a cut, nor of a whole sentence.
_STOP_LIKE = r"[.!?·,]\p{Z}*[\"»”“’')\]]*\s*$"


def ending_features(df: DataFrame, doc_id: str, text: str, source: str, boxes: str | None) -> DataFrame:
    """Per text that is neither null nor blank: its lengths and what its end looks like; the text itself is left out."""
    t = F.col(text).cast("string")
    n_boxes = F.size(F.col(boxes)) if boxes else F.lit(None).cast("int")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), t.alias("t"), n_boxes.alias("boxes"))
    rows = rows.where(F.col("t").rlike(r"[^\s\p{Z}\x{200B}\x{FEFF}]"))
    body = F.regexp_replace("t", r"[\s\p{Z}]+$", "")
    rows = rows.withColumn("tail", F.substring_index(body, "\n", -2))
    lines = F.split("tail", "\r?\n")
    rows = rows.select(
        "doc_id",
        "source",
        "boxes",
        F.char_length("t").cast("long").alias("chars"),
        # A byte limit may split a letter, whose rest a reader shows as U+FFFD: three bytes for the one or two left.
        F.octet_length(F.regexp_replace("t", r"\x{FFFD}+$", "")).cast("long").alias("bytes"),
        (F.char_length("t") - F.char_length(F.replace("t", F.lit("\n"), F.lit(""))) + F.when(F.col("t").endswith("\n"), 0).otherwise(1))
        .cast("long")
        .alias("lines"),
        F.col("tail").rlike(_MARK).alias("mark"),
        F.col("tail").rlike(_TERMINAL).alias("terminal"),
        F.col("tail").rlike(_STOP_LIKE).alias("stop_like"),
        F.element_at(lines, -1).alias("last"),
        F.when(F.size(lines) > 1, F.element_at(lines, -2)).otherwise("").alias("prior"),
    )
    # In pages of joined columns the page ends in the last column of its last line.
    last = F.trim(F.element_at(F.split("last", r"\t|\||\s{3,}"), -1))
    # A short last line may be the rest of an advert that begins in the line before.
    ends = F.array(last, F.when(F.size(F.split(last, r"\s+")) <= 3, F.trim("prior")).otherwise(""))
    return rows.select(
        "doc_id", "source", "boxes", "chars", "bytes", "lines", "mark", "stop_like",
        (F.col("terminal") & ~F.col("mark")).alias("terminal"),
        F.when(~F.col("stop_like") & ~F.col("mark"), F.transform(ends, _plain)).alias("ends"),
    )


def _plain(line: Column) -> Column:
    """A line in lower case, with one sign for all digits."""
    return F.lower(F.translate(line, "123456789", "000000000"))


def closing_openings(docs: DataFrame, text: str, features: DataFrame) -> DataFrame:
    """``(opening, at)``: how lines begin that stand alone and end pages, such as adverts, signatures and pointers.

    ``opening`` is one word or two, the first of the line (``at`` 0) or the second and third (``at`` 1, as in the name
    of a firm). They are learned from the texts: running text is broken into lines anywhere, so its words stand at the
    start of a line about as often as a line has words, while the words that open an advert always stand there. A heading
    too stands alone, but does not end pages. Candidates are the openings of last lines, at most three a page and each of
    ``OPENING_SHARE`` of the pages, so there are at most 3 / ``OPENING_SHARE``, and these alone are counted in all texts.
    """
    last = F.split(F.element_at("ends", 1), r"\s+")
    keyed = F.explode(
        F.array(
            F.struct(F.get(last, F.lit(0)).alias("opening"), F.lit(0).alias("at")),
            F.struct(F.concat_ws(" ", F.get(last, F.lit(0)), F.get(last, F.lit(1))).alias("opening"), F.lit(0).alias("at")),
            F.struct(F.concat_ws(" ", F.get(last, F.lit(1)), F.get(last, F.lit(2))).alias("opening"), F.lit(1).alias("at")),
        )
    ).alias("k")
    ending = features.where("ends IS NOT NULL").select(keyed).select("k.*").where(F.col("opening").rlike(r"\p{L}.*"))
    ending = ending.where((F.col("at") == 0) | F.col("opening").contains(" "))
    pages = F.lit(features.count()) * OPENING_SHARE
    ending = ending.groupBy("opening", "at").agg(F.count("*").alias("last")).where(F.col("last") >= F.greatest(F.lit(OPENING_PAGES), pages))

    counted = features.agg(F.count("*").alias("pages"), F.sum("lines").alias("lines"))
    whole = _plain(F.regexp_replace(F.col(text).cast("string"), _BROKEN, "$1\u0001"))
    pieces = docs.select(F.explode(F.split(whole, _PIECES)).alias("p"))
    # A piece has no white space but blanks, mostly single ones: splitting at one needs no pattern.
    words = pieces.select(F.split(F.trim("p"), " ").alias("ws")).select("ws", F.posexplode("ws").alias("j", "w"))
    words = words.select("j", "w", F.concat_ws(" ", "w", F.get("ws", F.col("j") + 1)).alias("two"))
    words = words.select("j", F.explode(F.when(F.col("w") == F.col("two"), F.array("w")).otherwise(F.array("w", "two"))).alias("met"))
    every = words.join(bounded_broadcast(ending, int(3 / OPENING_SHARE), 64), F.col("met") == F.col("opening"))
    every = every.groupBy("opening", "at", "last").agg(F.count("*").alias("any"), F.count_if(F.col("j") == F.col("at")).alias("alone"))
    ends_pages = F.col("last") * F.col("lines") >= ENDS_PAGES * F.col("pages") * F.col("alone")
    return every.crossJoin(F.broadcast(counted)).where((F.col("alone") >= STANDS_ALONE * F.col("any")) & ends_pages).select("opening", "at")


def _closes(ends: Column, openings: list[tuple[str, int]]) -> Column:
    """Whether one of the lines is a signature or begins as a line that stands alone; one letter in ``OPENING_LETTERS`` may be misread."""

    def begins(line: Column, opening: Column) -> Column:
        n = F.length(opening)
        return F.levenshtein(F.substr(line, F.lit(1), n), opening) * OPENING_LETTERS <= n

    tests = lambda x: x.rlike(_SIGNED)
    for at in (0, 1):
        known = [o for o, k in openings if k == at]
        if known:
            these = F.array(*[F.lit(o + " ") for o in known])
            start = (lambda x: F.concat(x, F.lit(" "))) if at == 0 else (lambda x: F.concat(F.regexp_replace(x, r"^\S+\s+", ""), F.lit(" ")))
            tests = (lambda before, start, these: lambda x: before(x) | F.exists(these, lambda o: begins(start(x), o)))(tests, start, these)
    return F.exists(ends, tests)


MEASURES = ("chars", "bytes", "lines")


def _spikes(long: DataFrame) -> DataFrame:
    """The spikes of the histograms of ``(source, measure, length, ended)``."""
    histogram = long.groupBy("source", "measure", "length").agg(F.count("*").alias("n"), F.sum("ended").alias("ended"))
    # One row a length, so the windows of a source hold its different lengths, not its texts.
    lengths = Window.partitionBy("source", "measure")
    by_ratio, tenth = lengths.orderBy((F.ln(F.col("length") + SHORT) * 1e9).cast("long")), -int(math.log(0.9) * 1e9)
    below, above = by_ratio.rangeBetween(-tenth, -1), by_ratio.rangeBetween(1, tenth)
    width = (F.col("length") + SHORT) / 10
    around = histogram.select(
        "source", "measure", "length", "n", "ended",
        F.count("*").over(lengths).alias("lengths"),
        F.greatest(F.coalesce(F.sum("n").over(below), F.lit(0)), F.coalesce(F.sum("n").over(above), F.lit(0))).alias("near"),
        F.coalesce(F.sum("ended").over(below), F.lit(0)).alias("near_ended"),
    )
    mean = (F.col("near") + 1) / width
    chance = F.col("n") * F.ln(F.col("n") / mean) - (F.col("n") - mean)
    is_spike = (F.col("n") >= SPIKE_RATIO * F.col("near") / width) & (F.col("n") > mean) & (chance >= F.ln(F.col("lengths") / SPIKE_CHANCE))
    return around.where(is_spike).select(
        "source", "measure", "length", F.col("n").alias("texts"), (F.col("ended") > 2 * F.col("near_ended") / width).alias("flag_whole")
    )


def _at_spikes(features: DataFrame, spikes: DataFrame) -> DataFrame:
    """The features with the number of texts and ``flag_whole`` of the spike that each length of a text is at, if any."""
    n_spikes, rows = spikes.count(), features
    for m in MEASURES:
        at = spikes.where(F.col("measure") == m).select(
            F.col("source").alias("s"), F.col("length").alias("at"), F.col("texts").alias(f"{m}_texts"), F.col("flag_whole").alias(f"{m}_whole")
        )
        rows = rows.join(bounded_broadcast(at, n_spikes, 128), F.col("source").eqNullSafe(F.col("s")) & (F.col(m) == F.col("at")), "left").drop("s", "at")
    return rows


def length_spikes(features: DataFrame) -> DataFrame:
    """``(source, measure, length, texts, flag_whole)``: every spike of each source's length histograms.

    A spike is a length of ``SPIKE_RATIO`` times as many texts as the lengths in the tenth below, and in that above, have
    on average, where a Poisson number of that mean reaches the texts' number with a chance below ``SPIKE_CHANCE`` over
    all lengths of the histogram (bounded as by Chernoff). A source may have several, of limits that changed. A limit in one
    measure crowds the lengths in the others, too: so each text at several spikes counts for that with the most texts, and the
    spikes are tested again without the texts that count elsewhere. ``flag_whole`` says that even the spike's texts with a
    finished end are mostly cut ones: there are more than twice as many as such texts per length just below.
    """
    ended = (F.col("terminal") | F.col("closing")).cast("long").alias("ended")
    by_measure = F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "length")
    first = materialize(_spikes(features.select("source", ended, by_measure)), "spikes")
    rows = _at_spikes(features, first)
    most = F.greatest(*[F.coalesce(f"{m}_texts", F.lit(0)) for m in MEASURES])
    # For each measure the length, or null where the text counts for a spike of another measure.
    own = [F.when((most == 0) | (F.coalesce(f"{m}_texts", F.lit(0)) == most), F.col(m)) for m in MEASURES]
    left = rows.select("source", ended, F.explode(F.create_map(*[x for m, c in zip(MEASURES, own) for x in (F.lit(m), c)])).alias("measure", "length"))
    return _spikes(left.where("length IS NOT NULL"))


def find_truncated(df: DataFrame, doc_id: str, text: str, source: str, boxes: str | None = None) -> DataFrame:
    """``(doc_id, source, cut, reason)`` of every text that is neither null nor blank.

    Method: for each source the histograms of length in characters, bytes and lines are tested for spikes
    (``length_spikes``). A text at a spike length is cut (``limit``) unless it ends in terminal punctuation or in a
    line that stands alone, such as an advert, a signature or a pointer (``closing_openings`` learns how these begin);
    those too are flagged (``limit_whole``) where the histogram says that most such texts at the spike are cut by chance
    after a sentence. Limits leave a spike, but transfers break anywhere: a text is also cut if it ends in a mark of omission
    or half a letter (``mark``), if the layout has more boxes than the text has lines (``lines``), or if its last
    sentence is unfinished and no closing line (``unfinished``).

    The texts are read twice, for their ends and for the learned openings; what follows works on a narrow table of lengths
    and flags. Histograms are summed by Spark before the shuffle, and from them one row for each source and measure
    is made, so a source of any size is no hot group.

    Defined cases: null, empty and blank texts are no rows of the result; the rows without a source are a source of their
    own; null or no boxes are no evidence; repeated rows give repeated results; an empty table gives no rows; other columns
    are ignored; a long text is read whole.
    """
    features = materialize(ending_features(df, doc_id, text, source, boxes), "endings")
    openings = [(r["opening"], r["at"]) for r in closing_openings(df, text, features).orderBy("at", "opening").collect()]
    closing = F.when(F.col("ends").isNull(), False).otherwise(_closes(F.col("ends"), openings))
    features = materialize(features.select("*", closing.alias("closing")).drop("ends"), "closings")
    rows = _at_spikes(features, materialize(length_spikes(features), "spikes"))
    whole = F.col("terminal") | F.col("closing")
    at = [F.col(f"{m}_texts").isNotNull() for m in MEASURES]
    at_whole = [F.coalesce(f"{m}_whole", F.lit(False)) for m in MEASURES]
    reason = (
        F.when((at[0] | at[1] | at[2]) & ~whole, "limit")
        .when(at_whole[0] | at_whole[1] | at_whole[2], "limit_whole")
        .when(F.col("mark"), "mark")
        .when(F.col("boxes") > F.col("lines"), "lines")
        .when(~F.col("stop_like") & ~F.col("closing"), "unfinished")
    )
    return rows.select("doc_id", "source", reason.isNotNull().alias("cut"), reason.alias("reason"))


def truncation_by_source(df: DataFrame, doc_id: str, text: str, source: str, boxes: str | None = None) -> DataFrame:
    """``(source, texts, cut_texts, cut_share)`` of each source, a null source included; ``texts`` counts all its rows."""
    found = find_truncated(df, doc_id, text, source, boxes)
    cut = found.groupBy("source").agg(F.count_if("cut").alias("cut_texts"))
    all_rows = df.groupBy(F.col(source).cast("string").alias("s")).agg(F.count("*").alias("texts"))
    joined = all_rows.join(cut, F.col("s").eqNullSafe(F.col("source")), "left")
    n = F.coalesce("cut_texts", F.lit(0))
    return joined.select(F.col("s").alias("source"), "texts", n.alias("cut_texts"), F.round(n / F.col("texts"), 6).alias("cut_share"))
