"""Speech transcripts as clean, ordered speaker turns.

Each row is cleaned by itself: garbled characters repaired, time stamps, sound annotations and fillers taken out, labels inside the
content found. Words that may be fillers go only where the words and pauses around them say so. Labels are settled by equi-joins with
the spellings of the document's speakers, never by comparing all with all.

The clock of a document that was recorded in several files starts anew with each. Restarts are seen in the order of ordinals, every file
segment is moved behind the one before, and inside the segments starts and ends are made consistent by isotonic regression. Turns are
made in two levels, inside blocks of a document and then over one summary row per block, so that a document of any length is
spread over many tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.encoding import repair_text
from lodestrata.session import cut

#: Rows of a document whose missing start times are filled in one task, and rows whose clock is fitted in one.
ORDINALS, FITTED = 2000, 5000
#: Seconds of audio in a block.
BLOCK_S = 3600.0
#: A file segment begins where the clock falls by more than RESET_S, two rows before against two after, to less than RESTART_S.
RESET_S, RESTART_S = 600.0, 300.0

_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
#: Time stamps in the notations of transcription tools.
STAMP = re.compile(rf"[\[(<{{]\s*(?:{_CLOCK}|\d+(?:\.\d+)?\s*s|(?:\d+h)?\d+m\d+s)\s*[\])>}}](?:\s*-->)?|\b{_CLOCK}\b(?:\s*-->(?:\s*{_CLOCK}\b)?)?|-->")
#: Words that say what is heard, and words that may stand beside them in an annotation.
SOUNDS = frozenset(
    "inaudible crosstalk applause laughter laughs laughing laugh music ringing rings coughs coughing cough noise noises voices pause pauses silence sighs sigh unintelligible indiscernible "
    "language difficulty difficulties throat chuckles chuckling beep beeps static feedback cheers cheering clapping sneezes gasps".split()
)
BESIDE = frozenset("phone background foreign technical clears clearing long short brief loud soft in the and of on line audio a plays playing continues speaking s m".split())
BRACKETED = re.compile(r"\[([^\[\]\n]*)\]|<([^<>\n]*)>|\{([^{}\n]*)\}|\(([^()\n]*)\)|\*([a-z][a-z ]*)\*", re.IGNORECASE)
SUNG = re.compile(r"[♪♫][^♪♫\n]*[♪♫]|[♪♫]")
TAG = re.compile(r"/?[a-z]\w*/?")
#: Sounds of hesitation, and phrases that are fillers or not.
HESITATIONS = ("um", "umm", "uh", "uhh", "erm", "er", "ah", "hm", "hmm", "mm", "mhm", "mm-hmm", "uh-huh")
PHRASES = ("you know", "i mean", "kind of", "sort of")
FILLER = re.compile(r"(,\s*)?(?<![\w'’-])(" + "|".join(re.escape(f) for f in sorted((*HESITATIONS, *PHRASES), key=len, reverse=True)) + r")(?![\w'’-])((?:\s*[,…—–]|\.{2,})*)", re.IGNORECASE)
#: Words before or behind which a phrase is part of the sentence: determiners before a kind or sort of something, auxiliaries,
#: conjunctions and question words before a clause's own verb, and what such a verb takes behind it.
DETERMINERS = frozenset("what which a an the this that these those any some every each no same other another certain new different right wrong one all first only such many several various our your their his her its my".split())
BEFORE_VERB = frozenset("do does did don't didn't doesn't don’t didn’t doesn’t if as what that let whether how when since because all would could should can may might will to which who whom whatever everything before once unless where why".split())
BEHIND_VERB = frozenset("what that how why who where when whether if about it him her them the this these those which our your my by to business".split())
_LAST = re.compile(r"([\w'’]*)([^\w'’]*)$")
_NEXT = re.compile(r"\s*([\w'’]*)")


def _annotation(match: re.Match) -> str:
    """Nothing for brackets that hold sounds alone, or a mark-up tag; all else is speech and stays."""
    inner = next(g for g in match.groups() if g is not None).lower()
    words = re.findall(r"[^\W\d_]+", inner)
    sound = any(w in SOUNDS for w in words) and all(w in SOUNDS or w in BESIDE for w in words)
    return " " if sound or not any(c.isalnum() for c in inner) or match.group(2) is not None and TAG.fullmatch(inner) else match.group()


def _filler(match: re.Match) -> str:
    """Nothing for a filler, by the words and pauses around it; the words themselves where they are part of the sentence."""
    lead, said, tail = match.groups(default="")
    text, low = match.string, said.lower()
    nothing = " " if "," in tail else lead + " "
    word, gap = _LAST.search(text, max(0, match.start() - 40), match.start()).groups()
    if low in HESITATIONS:
        # an abbreviation in capitals, and millimetres, are no hesitation
        capitals = len(said) > 1 and said.isupper() and any(c.islower() for c in text)
        return match.group() if capitals or low == "mm" and word.isdigit() else nothing
    pause_behind = bool(tail) or text[match.end() : match.end() + 1] in ".?!;:" or not text[match.end() :].strip()
    apart = not word or any(c in gap + lead for c in ",.;:?!…—–")
    if apart and pause_behind:
        return nothing
    following = _NEXT.match(text, match.end()).group(1).lower()
    before = "" if apart else word.lower()
    if low in ("kind of", "sort of"):
        return match.group() if before in DETERMINERS else nothing
    if before in BEFORE_VERB:
        return match.group()
    clause = following in BEHIND_VERB and (apart or low == "i mean" and following in ("what", "it", "that", "by", "business"))
    return match.group() if clause and not pause_behind else nothing


def without_noise(text: str) -> str:
    """A text without time stamps, sound annotations and fillers."""
    return FILLER.sub(_filler, SUNG.sub(" ", BRACKETED.sub(_annotation, STAMP.sub(" ", text))))


#: A possible label: at the start, after a line break or after a sentence, up to a colon.
_NAME = r"([^\W\d_](?:[^\n:?!.>]|(?<=\b[^\W\d_])\.|\.(?=\s*:)){0,78}?)\s*:(?=\s|$)"
LABEL = re.compile(rf"(?:^|\n|(?<=[.?!…])\s)\s*(?:>+|[-–•*])?\s*{_NAME}|>>+\s*{_NAME}")
#: Labels that name nobody.
NOBODY = ("", "unk", "unknown", "unidentified", "unidentified speaker", "n a", "none", "null", "speaker")


def tidy(text: str) -> str:
    """An utterance without stamps, annotations and fillers, spaced and capitalised as prose; empty if no speech is left."""
    text = re.sub(r"\s+([,.;:?!…])", r"\1", re.sub(r"\s+", " ", without_noise(text))).strip(" -–—>•*")
    text = re.sub(r"^[,;:.…\s]+", "", re.sub(r"([,;])(?:\s*[,;])+", r"\1", text))
    if not any(c.isalnum() for c in text):
        return ""
    text = re.sub(r"(?:^|(?<=[.?!] ))[a-z]", lambda m: m.group().upper(), text)
    return text if text[-1] in ".?!…”\"')" else text + "."


def parts(content: str | None) -> list[tuple[str | None, str]]:
    """(possible label before it, tidy speech) of every stretch of a row's content; the first has no label."""
    if not content:
        return []
    text = re.sub(r"[^\S\n]+", " ", without_noise(repair_text(content)))
    found, label, done = [], None, 0
    for m in LABEL.finditer(text):
        found.append((label, tidy(text[done : m.start()])))
        label, done = FILLER.sub(" ", m.group(1) or m.group(2)), m.end()
    found.append((label, tidy(text[done:])))
    return found


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting. Both sides grow with the corpus, and a planner that reckons with compressed files, and not with what exploding
    adds, would send whole sides through the driver."""
    return left.join(right.hint("merge"), on, how)


def label_key(label: Column) -> Column:
    """The words of a label in lower case and alphabetical order; 'Speaker 4', 'SPK_04' and 'spk4' all give 'spk 4'; null for nobody."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(label, r"\s*:\s*$", "")), r"[^\p{L}\p{N}]+", " "))
    numbered = F.regexp_extract(plain, r"^(?:speaker|spk|spkr|sp)\s?0*(\d+)$", 1)
    words = F.array_join(F.array_sort(F.split(plain, " ")), " ")
    return F.when(numbered != "", F.concat(F.lit("spk "), numbered)).when(~plain.isin(*NOBODY), words)


def speaker_spellings(speakers: DataFrame) -> DataFrame:
    """document_id, key, speaker_no: every spelling that names one speaker of its document; spellings of two are left out."""
    name = F.split(F.trim(F.regexp_replace("full_name", r"\s+", " ")), " ")
    first, last = F.element_at(name, 1), F.element_at(name, -1)
    forms = F.array(F.lit(""), F.col("full_name"), last, first, F.concat(F.substring(first, 1, 1), F.lit(" "), last))
    ranks = F.array_compact(F.array(F.lit(""), F.col("role"), F.col("title"), F.col("firm"), F.concat_ws(" ", "role", "firm"), F.concat_ws(" ", "title", "firm"), F.concat_ws(" ", "role", "title")))
    each = speakers.filter("document_id is not null and speaker_no is not null").select("document_id", "speaker_no", F.explode(F.array_distinct(forms)).alias("form"), ranks.alias("ranks"))
    each = each.select("document_id", "speaker_no", "form", F.explode("ranks").alias("rank"))
    each = each.select("document_id", "speaker_no", label_key(F.concat_ws(" ", "form", "rank")).alias("key")).filter("key is not null")
    numbers = speakers.filter("document_id is not null").select("document_id", "speaker_no", F.concat(F.lit("spk "), F.col("speaker_no").cast("string")).alias("key")).filter("key is not null")
    one = each.unionByName(numbers).groupBy("document_id", "key").agg(F.min("speaker_no").alias("speaker_no"), F.max("speaker_no").alias("_most"))
    return one.filter("speaker_no = _most").drop("_most")


def _deletions(word: Column) -> Column:
    """A word and what is left of it without any one of its letters."""
    each = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) >= 5, each).otherwise(F.array().cast("array<string>"))))


def resolve_labels(labels: DataFrame, speakers: DataFrame) -> DataFrame:
    """document_id, key -> document_id, key, speaker_no for the keys that name a speaker of the document, if need be after mending
    one wrong letter of a word. Keys that name nobody or two speakers give no row."""
    labels = labels.select("document_id", "key").filter("key is not null").distinct()
    known = speaker_spellings(speakers)
    seen = _joined(labels, known, ["document_id", "key"], "left")
    words = known.select("document_id", F.explode(F.split("key", " ")).alias("right")).filter(F.length("right") >= 5).distinct()
    near = words.select("document_id", "right", F.explode(_deletions(F.col("right"))).alias("cut"))
    lost = seen.filter("speaker_no is null").select("document_id", "key", F.posexplode(F.split("key", " ")).alias("at", "word"))
    mended = lost.filter(F.length("word") >= 5).select("document_id", "word").distinct().withColumn("cut", F.explode(_deletions(F.col("word"))))
    mended = _joined(mended, near, ["document_id", "cut"]).filter(F.levenshtein("word", "right") <= 1)
    mended = mended.groupBy("document_id", "word").agg(F.min(F.struct(F.levenshtein("word", "right").alias("d"), "right")).alias("m")).select("document_id", "word", F.col("m.right").alias("right"))
    again = _joined(lost, mended, ["document_id", "word"], "left").groupBy("document_id", "key").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("right", "word"))), " ").alias("mended"))
    again = _joined(again, known.withColumnRenamed("key", "mended"), ["document_id", "mended"]).select("document_id", "key", "speaker_no")
    return seen.filter("speaker_no is not null").select("document_id", "key", "speaker_no").unionByName(again)


def isotonic(values: np.ndarray) -> np.ndarray:
    """The nondecreasing values with the least squared distance from `values` (pooling adjacent violators)."""
    levels: list[float] = []
    sizes: list[int] = []
    for v in values.tolist():
        levels.append(v)
        sizes.append(1)
        while len(levels) > 1 and levels[-2] > levels[-1]:
            n = sizes[-2] + sizes[-1]
            levels[-2:] = [(levels[-2] * sizes[-2] + levels[-1] * sizes[-1]) / n]
            sizes[-2:] = [n]
    return np.repeat(levels, sizes)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_ob", F.floor(F.coalesce("ordinal", F.lit(0)) / ORDINALS))


def document_clock(rows: DataFrame) -> DataFrame:
    """Rows (document_id, id, ordinal, start, stop, ...) with start and stop on one clock per document, and `file` (from 0).

    A new file segment begins, in the order of ordinals, where both starts before lie more than RESET_S above both starts from there on, the
    first of which is less than RESTART_S; a row that is out of order alone makes none. Each segment is moved behind the latest time
    of the one before. NaN counts as missing; rows without a start take their file from the row before.
    """
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = _by_block(rows.withColumns({"start": clean("start"), "stop": clean("stop")}))
    inside = Window.partitionBy("document_id", "_ob").orderBy("ordinal", "id")
    known = rows.filter("start is not null").select("document_id", "_ob", "ordinal", "id", "start", "stop")
    place = F.struct("ordinal", "id")
    edges = known.groupBy("document_id", "_ob").agg(F.min_by("start", place).alias("first"), F.max_by("start", place).alias("last"))
    along = Window.partitionBy("document_id").orderBy("_ob")
    edges = edges.select("document_id", "_ob", F.lag("last").over(along).alias("_p1"), F.lead("first").over(along).alias("_n1"))
    near = known.withColumns({"_l1": F.lag("start").over(inside), "_l2": F.lag("start", 2).over(inside), "_n": F.lead("start").over(inside)})
    near = _joined(near, edges, ["document_id", "_ob"])
    before = F.least(F.coalesce("_l1", "_p1"), F.coalesce("_l2", "_p1"))
    behind = F.greatest(F.col("start"), F.coalesce("_n", "_n1"))
    starts = near.withColumn("_new", F.coalesce((before - behind > RESET_S) & (F.col("start") < RESTART_S), F.lit(False)).cast("int"))
    starts = cut(starts.select("document_id", "_ob", "ordinal", "id", "start", "stop", "_new"))
    if starts.filter("_new = 1").isEmpty():  # one file each
        return rows.withColumn("file", F.lit(0)).drop("_ob")
    counts = starts.groupBy("document_id", "_ob").agg(F.sum("_new").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = _joined(starts.withColumn("_in", F.sum("_new").over(inside)), counts.select("document_id", "_ob", earlier.alias("_off")), ["document_id", "_ob"]).withColumn("file", F.col("_in") + F.col("_off"))
    files = starts.groupBy("document_id", "file").agg(F.max(F.greatest("start", F.coalesce("stop", "start"))).alias("most"))
    moved = F.coalesce(F.sum("most").over(Window.partitionBy("document_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = _joined(starts.select("document_id", "_ob", "ordinal", "id", "file"), files.select("document_id", "file", moved.alias("_by")), ["document_id", "file"])
    out = _joined(rows, starts.select("document_id", "id", "file", "_by"), ["document_id", "id"], "left")
    return out.withColumns({"start": F.col("start") + F.col("_by"), "stop": F.col("stop") + F.col("_by"), "file": F.col("file").cast("int")}).drop("_by", "_ob")


def _filled(rows: DataFrame) -> DataFrame:
    """Adds t (own or preceding start, -1 before any) and anchor (the ordinal that start came from), by ordinal within a document."""
    rows = _by_block(rows)
    here = F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("t"), F.col("ordinal").alias("anchor")))
    own = F.last(here, ignorenulls=True).over(Window.partitionBy("document_id", "_ob").orderBy("ordinal", "id"))
    last = rows.filter("start is not null").groupBy("document_id", "_ob").agg(F.max_by(F.struct(F.col("start").alias("t"), F.col("ordinal").alias("anchor")), F.struct("ordinal", "id")).alias("_last"))
    # one summary row per block of ordinals that has a start: it holds for the blocks up to the next such
    blocks = _joined(rows.select("document_id", "_ob").distinct(), last, ["document_id", "_ob"], "left")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("document_id").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select("document_id", "_ob", before.alias("_before"))
    rows = _joined(rows.withColumn("_own", own), carried, ["document_id", "_ob"])
    at = F.coalesce("_own", "_before")
    return rows.withColumn("t", F.coalesce(at["t"], F.lit(-1.0))).withColumn("anchor", F.coalesce(at["anchor"], F.lit(-1))).drop("_own", "_before", "_ob")


def speech_events(chunks: DataFrame, speakers: DataFrame, texts: bool = False) -> DataFrame:
    """One row per stretch of speech of the documents in `speakers`, in order of (segment, t, anchor, ordinal, id, seq):
    document_id, id, seg (block: an hour of audio), t, anchor, ordinal, seq, named (speaker or null), start_s, end_s, text (if `texts`).

    Of rows with one document_id and ordinal only the smallest id counts; rows without an ordinal all count. Rows without speech
    give none. start_s and end_s are on the document's clock, repaired by isotonic regression.
    """
    transcripts = speakers.select("document_id").filter("document_id is not null").distinct()
    own = chunks.select("document_id", "id", "ordinal", "content", F.col("audio_start_s").alias("start"), F.col("audio_end_s").alias("stop"), "speaker")
    own = own.filter("content is not null and id is not null").join(transcripts, "document_id", "left_semi")
    schema = "document_id long, id long, ordinal int, start double, stop double, speaker string, parts array<struct<label:string,text:string>>"

    def take(batches):
        for pdf in batches:
            said = [[{"label": a, "text": t if texts else "x" if t else ""} for a, t in parts(c)] for c in pdf.content]
            some = pdf.drop(columns="content").assign(parts=said, speaker=pdf.speaker.astype(object))
            some["ordinal"] = some.ordinal.astype("Int32")
            yield some[["document_id", "id", "ordinal", "start", "stop", "speaker", "parts"]]

    rows = cut(own.mapInPandas(take, schema))  # parsed once, read by several stages
    alone = F.when(F.col("ordinal").isNull(), F.col("id"))
    rows = rows.groupBy("document_id", "ordinal", alone.alias("_alone")).agg(F.min(F.struct("id", "start", "stop", "speaker", "parts")).alias("r"))
    rows = rows.select("document_id", "ordinal", "r.*")
    rows = _filled(document_clock(rows)).filter(F.exists("parts", lambda p: p["text"] != ""))
    events = rows.select("document_id", "id", "ordinal", "start", "stop", "t", "anchor", "speaker", F.posexplode("parts").alias("seq", "p"))
    events = events.withColumn("key", label_key(F.when(F.col("seq") == 0, F.col("speaker")).otherwise(F.col("p.label")))).withColumn("text", F.col("p.text")).drop("p", "speaker")
    named = resolve_labels(events.select("document_id", "key"), speakers).withColumnRenamed("speaker_no", "named")
    events = _joined(events, named, ["document_id", "key"], "left")
    # an hour of audio is a block; so are ORDINALS rows that stand before any time
    events = events.withColumn("seg", F.when(F.col("t") < 0, F.floor(F.coalesce("ordinal", F.lit(0)) / ORDINALS) - (1 << 40)).otherwise(F.floor(F.col("t") / BLOCK_S)).cast("long"))
    return cut(repair_clock(events.select("document_id", "id", "ordinal", "start", "stop", "seg", "t", "anchor", "seq", "named", "text")))


def repair_clock(events: DataFrame) -> DataFrame:
    """Replaces start, stop by start_s <= end_s <= the next row's start_s, fitted by isotonic regression per (document_id, seg), of which
    at most FITTED rows are fitted together.

    The boundaries of the rows that have both times are fitted; a row without an end ends where it starts or the next begins.
    """
    order = Window.partitionBy("document_id", "seg").orderBy("t", "anchor", F.asc_nulls_last("ordinal"), "id")
    events = events.withColumn("_lot", F.floor((F.dense_rank().over(order) - 1) / FITTED))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "anchor", "ordinal", "id", "seq"], na_position="last", kind="stable")
        row = np.concatenate([[True], pdf.id.to_numpy()[1:] != pdf.id.to_numpy()[:-1]])
        first = pdf[row]
        start = first.t.to_numpy(float)
        stop = np.where(np.isnan(first.stop.to_numpy(float)), np.append(start[1:], start[-1:]), first.stop.to_numpy(float))
        both = isotonic(np.stack([start, stop], axis=1).ravel()).reshape(-1, 2)
        k = np.cumsum(row) - 1
        out = pdf.drop(columns=["start", "stop", "_lot"])
        out["start_s"], out["end_s"] = both[k, 0], both[k, 1]
        out["ordinal"], out["named"] = out.ordinal.astype("Int32"), out.named.astype("Int32")
        return out

    schema = "document_id long, id long, ordinal int, seg long, t double, anchor int, seq int, named int, text string, start_s double, end_s double"
    return events.groupBy("document_id", "seg", "_lot").applyInPandas(fit, schema)


def with_turns(events: DataFrame) -> DataFrame:
    """Adds speaker_no and turn (numbered from 1 within the document) to the events that hold speech; speech before anybody is
    named belongs to no turn and is left out."""
    order = [F.col(c) for c in ("start_s", "t", "anchor", "ordinal", "id", "seq")]
    inside = Window.partitionBy("document_id", "seg").orderBy(*order)
    place = F.struct(*order)
    segments = events.groupBy("document_id", "seg").agg(F.max_by("named", F.when(F.col("named").isNotNull(), place)).alias("last"))
    before = Window.partitionBy("document_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.select("document_id", "seg", F.last("last", ignorenulls=True).over(before).alias("before"))
    said = events.withColumn("speaker_no", F.last("named", ignorenulls=True).over(inside)).filter("text <> ''")
    said = _joined(said, segments, ["document_id", "seg"])
    said = said.withColumn("speaker_no", F.coalesce("speaker_no", "before")).filter("speaker_no is not null").drop("before")
    ends = said.groupBy("document_id", "seg").agg(F.max_by("speaker_no", place).alias("end"))
    ends = ends.select("document_id", "seg", F.lag("end").over(Window.partitionBy("document_id").orderBy("seg")).alias("end"))
    said = _joined(said, ends, ["document_id", "seg"]).withColumn("_prev", F.coalesce(F.lag("speaker_no").over(inside), "end"))
    said = said.withColumn("_new", (F.col("_prev").isNull() | (F.col("_prev") != F.col("speaker_no"))).cast("int")).withColumn("_run", F.sum("_new").over(inside)).drop("_prev", "end")
    counts = said.groupBy("document_id", "seg").agg(F.sum("_new").alias("_n"))
    counts = counts.select("document_id", "seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return _joined(said, counts, ["document_id", "seg"]).withColumn("turn", F.col("_run") + F.col("_off")).drop("_new", "_run", "_off")


def turns(events: DataFrame) -> DataFrame:
    """document_id, turn, speaker_no, first_chunk_id, last_chunk_id, start_s, end_s, utterances: one row per turn."""
    place = F.struct("seg", "start_s", "t", "anchor", "ordinal", "id", "seq")
    return with_turns(events).groupBy("document_id", "turn").agg(
        F.min("speaker_no").alias("speaker_no"), F.min_by("id", place).alias("first_chunk_id"), F.max_by("id", place).alias("last_chunk_id"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("utterances"),
    )
