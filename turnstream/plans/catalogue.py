"""The queries over the reference tables, by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstream.functions import markers, normalize, scalars
from turnstream.operators import align, cluster, features, folds, intervals, report
from turnstream.plans import bindings as b
from turnstream.plans.bindings import table, with_
from turnstream.plans.registry import QUERIES, SQL, query
from turnstream.sources import audio

__all__ = ["QUERIES", "SQL", "flagship"]


# --- frames and segmentation


def _walk(parts: int = 1) -> str:
    """CTEs that walk each stream's frames with the cutting state: walk(stream_id, part, rn, frame_no, chunk, len, run, nsil, cut)."""
    c = b.CUTTING
    trigger, silent, longest, n = c.minimum_trigger_ms * c.sample_rate, c.minimum_silent_ms * c.sample_rate, c.max_seconds * c.sample_rate, b.FRAME
    cut = f"(len * {n * 1000} >= {trigger} and run * {n * 1000} >= {silent}) or len * {n} >= {longest}"
    return f"""{with_('frames', recursive=True)},
parted as (select f.*, least({parts - 1}, f.frame_no // greatest(k // {parts}, 1)) as part from frames f join (select stream_id, count(*) as k from frames group by stream_id) using (stream_id)),
ranked as (select *, row_number() over (partition by stream_id, part order by frame_no) - 1 as rn from parted),
walk as (
 select *, {cut} as cut from (select stream_id, part, rn, frame_no, 0 as chunk, 1 as len, case when is_speech then 0 else 1 end as run, case when is_speech then 0 else 1 end as nsil from ranked where rn = 0)
 union all
 select *, {cut} as cut from (select r.stream_id, r.part, r.rn, r.frame_no, w.chunk + case when w.cut then 1 else 0 end as chunk, case when w.cut then 1 else w.len + 1 end as len,
  case when r.is_speech then 0 when w.cut then 1 else w.run + 1 end as run, case when w.cut then 0 else w.nsil end + case when r.is_speech then 0 else 1 end as nsil
  from walk w join ranked r on r.stream_id = w.stream_id and r.part = w.part and r.rn = w.rn + 1)),
chunks as (select stream_id, part, chunk as chunk_idx, min(frame_no) as start_frame, max(frame_no) + 1 as end_frame, max(nsil) as n_silent, count(*) * {n} as n_samples, max(nsil) / count(*) as silence_ratio, bool_or(cut) as closed from walk group by stream_id, part, chunk)"""


_CHUNK = "stream_id, chunk_idx, start_frame, end_frame, n_silent, n_samples, silence_ratio"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return folds.segment(b.frames(spark, d), ["stream_id"], b.CUTTING)


@query(f"{with_('frames')} select stream_id, frame_no, cast(is_speech as int) as speech, n_samples from frames")
def q01_frames(spark, d):
    return b.frames(spark, d).select("stream_id", "frame_no", F.col("is_speech").cast("int").alias("speech"), "n_samples")


@query(f"{_walk()} select {_CHUNK} from chunks")
def q02_vad_segments(spark, d):
    return _chunks(spark, d)


@query(f"{_walk(4)} select part, {_CHUNK} from chunks")
def q03_vad_parallel(spark, d):
    return folds.segment(folds.in_parts(b.frames(spark, d), ["stream_id"], 4), ["stream_id", "part"], b.CUTTING)


@query(f"{_walk()} select {_CHUNK} from chunks where closed")
def q04_vad_sequential_no_tail(spark, d):
    return folds.segment(b.frames(spark, d), ["stream_id"], b.CUTTING, tail=False)


@query(f"{_walk()} select {_CHUNK} from chunks where silence_ratio <= {b.REJECT}")
def q05_silence_filter(spark, d):
    return _chunks(spark, d).filter(F.col("silence_ratio") <= b.REJECT)


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"""select l_orderkey, l_linenumber, l_partkey, upto - len as start_ts, upto as end_ts from (select *, cast(l_quantity as bigint) as len,
 cast(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by {_LINE_ORDER} rows unbounded preceding) as bigint) as upto from lineitem)""")
def q06_global_timestamps(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER.split(", ")).rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("l_quantity").cast("long")
    upto = F.sum(length).over(w)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (upto - length).alias("start_ts"), upto.alias("end_ts"))


@query(f"{with_('frames')} select stream_id, frame_no * n_samples // 64000 as chunk_idx, count(*) as n_frames, sum(value)::bigint is not null as filled from frames group by all")
def q07_naive_chunks(spark, d):
    chunk = F.floor(F.col("frame_no") * F.col("n_samples") / (4 * b.CUTTING.sample_rate)).alias("chunk_idx")
    return b.frames(spark, d).groupBy("stream_id", chunk).agg(F.count("*").alias("n_frames"), F.max(F.col("value").isNotNull()).alias("filled"))


@query(f"""{with_('frames')}, changes as (select *, case when is_speech is distinct from lag(is_speech) over w then 1 else 0 end as new from frames window w as (partition by stream_id order by frame_no)),
runs as (select *, cast(sum(new) over (partition by stream_id order by frame_no rows unbounded preceding) as bigint) - 1 as run_id from changes)
select stream_id, run_id, cast(bool_or(is_speech) as int) as speech, min(frame_no) as start_frame, count(*) as n_frames from runs group by stream_id, run_id""")
def q08_silence_runs(spark, d):
    w = Window.partitionBy("stream_id").orderBy("frame_no")
    new = F.when(F.col("is_speech").eqNullSafe(F.lag("is_speech").over(w)), 0).otherwise(1)
    runs = b.frames(spark, d).withColumn("new", new).withColumn("run_id", F.sum("new").over(w) - 1)
    return runs.groupBy("stream_id", "run_id").agg(F.max(F.col("is_speech").cast("int")).alias("speech"), F.min("frame_no").alias("start_frame"), F.count("*").alias("n_frames"))


@query(f"""{with_('frames', recursive=True)}, ema as (select stream_id, frame_no, value as x from frames where frame_no = 0 union all
 select f.stream_id, f.frame_no, e.x + 0.5::double * (f.value - e.x) from ema e join frames f on f.stream_id = e.stream_id and f.frame_no = e.frame_no + 1)
select stream_id, frame_no, cast(floor(x * 1000 + 0.5) as bigint) as volume_milli from ema""")
def q09_volume_ema(spark, d):
    frames = b.frames(spark, d).select("stream_id", F.col("frame_no").alias("item"), "value")
    smooth = folds.fold(frames, ["stream_id"], ["item"], ["value"], lambda: folds.Smoothing(0.5), "frame_no long, x double")
    return smooth.select("stream_id", "frame_no", F.floor(F.col("x") * 1000 + 0.5).cast("long").alias("volume_milli"))


# --- intervals


_BEST = """best as (select g.conv_id, g.turn, g.s, g.e, t.pos, t.speaker, row_number() over (partition by g.conv_id, g.turn order by case when t.pos is null then null else least(g.e, t.e) - greatest(g.s, t.s) end desc nulls last, t.pos) as k
 from seg g left join turns t on t.conv_id = g.conv_id and t.s < g.e and t.e > g.s and t.e > t.s)"""


@query(f"{with_('seg', 'turns')}, {_BEST} select conv_id, turn, coalesce(try_cast(replace(speaker, 'SPEAKER_', '') as int), 0) as speaker from best where k = 1")
def q10_overlap_speaker(spark, d):
    best = intervals.best_overlap(b.segments(spark, d), b.turns(spark, d), "conv_id", "turn")
    return best.select("conv_id", "turn", intervals.speaker_number(F.col("speaker")).alias("speaker"))


@query(f"""{with_('seg', 'turns')}, ranges as (select conv_id, row_number() over (partition by conv_id order by s, pos) as pos, pos as chunk, s, e, cast(pos as varchar) as speaker from turns where e > s),
best as (select g.conv_id, g.turn, t.chunk, row_number() over (partition by g.conv_id, g.turn order by case when t.pos is null then null else least(g.e, t.e) - greatest(g.s, t.s) end desc nulls last, t.pos) as k
 from seg g left join ranges t on t.conv_id = g.conv_id and t.s < g.e and t.e > g.s)
select conv_id, turn, coalesce(chunk, -1) as chunk_idx, case when chunk is null or chunk % 4 = 3 then 0 else (chunk * 7) % 3 end as speaker from best where k = 1""")
def q11_chunk_overlap_speaker(spark, d):
    turns = b.turns(spark, d).filter("e > s")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("s", "pos"))
    ranges = turns.select("conv_id", order.alias("pos"), "s", "e", F.col("pos").alias("speaker"))
    best = intervals.best_overlap(b.segments(spark, d), ranges, "conv_id", "turn").withColumnRenamed("speaker", "chunk_idx")
    assigned = turns.filter("pos % 4 <> 3").select("conv_id", F.col("pos").alias("chunk_idx"), ((F.col("pos") * 7) % 3).alias("speaker"))
    return best.join(assigned, ["conv_id", "chunk_idx"], "left").select("conv_id", "turn", F.coalesce("chunk_idx", F.lit(-1)).alias("chunk_idx"), F.coalesce("speaker", F.lit(0)).alias("speaker"))


_FILL = """filled as (select rec, chunk_idx, case when li is null and ri is null then 0 when li is null or ri - chunk_idx < chunk_idx - li then rv else lv end as speaker from (select rec, chunk_idx,
 last_value(case when spk is not null then chunk_idx end ignore nulls) over a as li, last_value(spk ignore nulls) over a as lv, last_value(case when spk is not null then chunk_idx end ignore nulls) over z as ri, last_value(spk ignore nulls) over z as rv
 from assigned window a as (partition by rec order by chunk_idx rows unbounded preceding), z as (partition by rec order by chunk_idx desc rows unbounded preceding)))"""
_ASSIGNED = "assigned as (select rec, chunk_idx, case when n_samples >= 8000 then label % 5 end as spk from emb)"


def _filled(spark, d) -> DataFrame:
    rows = b.chunk_embeddings(spark, d).select("rec", "chunk_idx", F.when(F.col("n_samples") >= 8000, F.col("label") % 5).alias("speaker"))
    return intervals.fill_nearest(rows, "rec", "chunk_idx", "speaker")


@query(f"{with_('emb')}, {_ASSIGNED}, {_FILL} select rec, chunk_idx, speaker from filled")
def q12_nearest_fill(spark, d):
    return _filled(spark, d).select("rec", "chunk_idx", "speaker")


@query("select doc_id, coalesce(list_min(list_filter([256, 1024, 4096, 16384], lambda x: x >= n_chars))::bigint, n_chars) as bucket from documents")
def q13_bucket_lookup(spark, d):
    return table(spark, d, "documents").select("doc_id", intervals.bucket_for(F.col("n_chars"), [256, 1024, 4096, 16384]).alias("bucket"))


_VOCABULARY = ["the", "of", "and", "to", "in", "der", "die", "de", "la", "que", "el", "et", "les", "und", "en"]


@query("""with vocabulary as (select unnest(['the','of','and','to','in','der','die','de','la','que','el','et','les','und','en']) as token, unnest(range(15)) as token_id),
words as (select doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+')) as token from documents)
select doc_id, count(*) as n_tokens, cast(sum(token_id) as bigint) as id_sum from words join vocabulary using (token) group by doc_id""")
def q14_token_dict_join(spark, d):
    # the vocabulary is a constant of fifteen entries
    known = F.create_map(*(x for i, w in enumerate(_VOCABULARY) for x in (F.lit(w), F.lit(i))))
    ids = F.filter(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.try_element_at(known, w)), lambda i: i.isNotNull())
    found = table(spark, d, "documents").select("doc_id", ids.alias("ids")).filter(F.size("ids") > 0)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query(f"{with_('emb')} select rec, chunk_idx from emb except select rec, chunk_idx from emb where n_samples >= 8000")
def q15_anti_skipped(spark, d):
    rows = b.chunk_embeddings(spark, d)
    return rows.select("rec", "chunk_idx").join(rows.filter("n_samples >= 8000").select("rec", "chunk_idx"), ["rec", "chunk_idx"], "left_anti")


@query(f"{with_('seg', 'shifted')} select g.conv_id, g.turn, cast(greatest(g.s, t.s) < least(g.e, t.e) as int) as intersects, case when greatest(g.s, t.s) < least(g.e, t.e) then greatest(g.s, t.s) else 0 end as cut_start, case when greatest(g.s, t.s) < least(g.e, t.e) then least(g.e, t.e) else 0 end as cut_end, least(g.s, t.s) as span_start, greatest(g.e, t.e) as span_end, greatest(0, greatest(g.s, t.s) - least(g.e, t.e)) as gap, cast(g.s <= t.s and t.e <= g.e as int) as contains from seg g join shifted t on t.conv_id = g.conv_id and t.pos = g.turn")
def q49_interval_algebra(spark, d):
    t = b.shifted(spark, d).select("conv_id", F.col("pos").alias("turn"), F.col("s").alias("ts"), F.col("e").alias("te"))
    a = intervals.algebra(F.col("s"), F.col("e"), F.col("ts"), F.col("te"))
    columns = [(c.cast("int") if n in ("intersects", "contains") else c).alias(n) for n, c in a.items()]
    return b.segments(spark, d).join(t, ["conv_id", "turn"]).select("conv_id", "turn", *columns)


@query(f"{with_('seg')} select conv_id, turn, case when s - lag(e) over w < 20 then lag(e) over w else s end as s, e from seg window w as (partition by conv_id order by turn)")
def q50_gap_clamp(spark, d):
    return intervals.clamp_gaps(b.segments(spark, d), "conv_id", "turn", 20).select("conv_id", "turn", "s", "e")


# --- texts


_STRIP = "regexp_replace(t, '^\\s+|\\s+$', '', 'g')"


def _joined(separator: str):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "t")))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), separator)


@query(f"{with_('seg')} select conv_id, md5(string_agg(t, '' order by turn)) as combined_md5, md5(string_agg(t, ' ' order by turn)) as spaced_md5 from seg group by conv_id")
def q16_combine_text(spark, d):
    return b.segments(spark, d).groupBy("conv_id").agg(F.md5(_joined("")).alias("combined_md5"), F.md5(_joined(" ")).alias("spaced_md5"))


@query("select source, min_by(lang, doc_id) filter (where lang is not null) as language from documents group by source")
def q17_first_language(spark, d):
    return report.first_of(table(spark, d, "documents").select("source", "doc_id", F.col("lang").alias("language")), "source", "doc_id", "language", F.col("language").isNotNull())


@query(f"{with_('seg')} select conv_id, 'unknown' as language, max_by(e, turn) as duration_cs, count(*) as n_segments, md5(string_agg(t, ' ' order by turn)) as text_md5 from seg group by conv_id")
def q18_verbose_response(spark, d):
    # the duration is the last segment's end, not the largest
    return b.segments(spark, d).groupBy("conv_id").agg(F.lit("unknown").alias("language"), F.max_by("e", "turn").alias("duration_cs"), F.count("*").alias("n_segments"), F.md5(_joined(" ")).alias("text_md5"))


@query(f"{with_('emb')}, {_ASSIGNED}, {_FILL} select rec, speaker, count(*) as n from filled group by rec, speaker")
def q19_speaker_histogram(spark, d):
    return _filled(spark, d).groupBy("rec", "speaker").agg(F.count("*").alias("n"))


def _marked(spark, d) -> DataFrame:
    """conv_id, text: the segments of each conversation as marker text; users speak as 0."""
    speaker = F.when(F.col("role") == "user", 0)
    one = b.segments(spark, d).select("conv_id", "turn", markers.marked(F.col("s") / 100, F.col("e") / 100, F.col("t"), speaker).alias("t"))
    return one.groupBy("conv_id").agg(_joined("").alias("text"))


def _parsed(spark, d, text) -> DataFrame:
    centi = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    return markers.parse(_marked(spark, d).withColumn("text", text), "text", ["conv_id"]).select("conv_id", "id", centi("start").alias("start_cs"), centi("end").alias("end_cs"), F.md5("text").alias("text_md5"), F.coalesce("speaker", F.lit(-1)).alias("speaker"))


_PARSED = "select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as id, s + {0} as start_cs, e + {0} as end_cs, md5(" + _STRIP + ") as text_md5, case when role = 'user' then 0 else -1 end as speaker from seg"


@query(f"{with_('seg')} {_PARSED.format(0)}")
def q20_parse_markers(spark, d):
    return _parsed(spark, d, F.col("text"))


@query(f"{with_('seg')} select conv_id, turn, md5({_STRIP}) as text_md5 from seg")
def q21_strip_markers(spark, d):
    one = b.segments(spark, d)
    return one.select("conv_id", "turn", F.md5(markers.without_markers(markers.marked(F.col("s") / 100, F.col("e") / 100, F.col("t")))).alias("text_md5"))


@query(f"{with_('seg')} {_PARSED.format('(conv_id % 7) * 100')}")
def q22_shift_markers(spark, d):
    return _parsed(spark, d, markers.shifted(F.col("text"), (F.col("conv_id") % 7) * 100))


@query(f"{with_('seg')} select conv_id, turn, md5(t) as text_md5 from seg")
def q23_strip_special_tokens(spark, d):
    noisy = F.concat(F.lit("<|startoftranscript|>"), F.lit("<|transcribe|>"), F.col("t"), F.lit("<|endoftext|>"))
    return b.segments(spark, d).select("conv_id", "turn", F.md5(markers.without_special_tokens(noisy)).alias("text_md5"))


def _normalize_sql(text: str) -> str:
    """text_normalize for RE2, which has no look-around: digit words are dropped from the list of words."""
    quoted = lambda x: x.replace("'", "''")
    out = f"regexp_replace(lower(coalesce({text}, '')), '\\([^)]*\\p{{Nd}}[^)]*\\)', ' ', 'g')"
    for old in normalize.WRITTEN_OUT:
        out = f"replace({out}, '{old}', '')"
    out = f"regexp_replace({out}, '(\\S+)[{normalize.QUOTES}](\\S+)', '\\1''\\2', 'g')"
    old, new = normalize.characters()
    out = f"translate({out}, '{quoted(old)}', '{new}')"
    words = f"list_filter(string_split_regex({out}, '\\s+'), lambda w: w <> '')"
    alone = f"regexp_matches({out}, '^[{normalize.DIGITS}]+$')"
    return f"case when {alone} then {out} else list_aggregate(list_filter({words}, lambda w: not regexp_full_match(w, '[{normalize.DIGITS}]+')), 'string_agg', ' ') end"


@query(f"select doc_id, md5(coalesce({_normalize_sql('text')}, '')) as norm_md5 from documents")
def q24_text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normalize.text_normalize(F.coalesce("text", F.lit("")))).alias("norm_md5"))


_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')"
_ROMAN = f"list_transform({_WORDS.replace('coalesce(text', 'coalesce(strip_accents(text)')}, lambda w: trim(regexp_replace(regexp_replace(array_to_string(string_split(w, ''), ' '), '[^a-z'' ]', ' ', 'g'), ' +', ' ', 'g')))"


@query(f"select doc_id, len({_WORDS}) as n_tokens, md5(coalesce(array_to_string({_ROMAN}, '|'), '')) as tokens_md5 from documents")
def q25_uroman_tokens(spark, d):
    words = normalize.words_of(F.lower(scalars.without_accents(F.coalesce("text", F.lit("")))))
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.md5(F.array_join(normalize.uroman_tokens(words), "|")).alias("tokens_md5"))


@query(f"select doc_id, 2 * len({_WORDS}) as n_tokens, md5(coalesce(array_to_string(list_transform({_WORDS}, lambda w: '<star>|' || w), '|'), '')) as tokens_md5 from documents")
def q26_star_tokens(spark, d):
    tokens = normalize.starred(normalize.words_of(F.lower(F.coalesce("text", F.lit("")))))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, "|")).alias("tokens_md5"))


@query("select doc_id, length(coalesce(text, '')) as n_tokens, md5(array_to_string(string_split(coalesce(text, ''), ''), '|')) as tokens_md5 from documents")
def q27_char_split(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.length(text).cast("long").alias("n_tokens"), F.md5(F.array_join(F.filter(F.split(text, ""), lambda c: c != ""), "|")).alias("tokens_md5"))


@query("select page_id, md5(regexp_replace(coalesce(html, ''), '\\([^)]*[0-9][^)]*\\)', ' ', 'g')) as html_md5 from pages")
def q28_bracket_digits(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.regexp_replace(F.coalesce("html", F.lit("")), r"\([^)]*[0-9][^)]*\)", " ")).alias("html_md5"))


# --- clustering and diarization


def _kmeans(source: str) -> str:
    """CTE walk(rec, i, centers, sizes, label) over source(rec, i, v)."""
    return f"""walk as (select rec, i, [v] as centers, [1] as sizes, 0 as label from {source} where i = 0
union all select rec, i,
 case act when 'move' then list_transform(centers, lambda c, k: case when k = near then list_transform(c, lambda x, j: (x * sizes[near] + v[j]) / (sizes[near] + 1)) else c end)
  when 'add' then list_append(centers, v)
  else list_transform(centers, lambda c, k: case when k = far then case when sizes[far] > 1 then list_transform(c, lambda x, j: (x * sizes[far] - v[j]) / (sizes[far] - 1)) else v end else c end) end,
 case act when 'move' then list_transform(sizes, lambda n, k: case when k = near then n + 1 else n end) when 'add' then list_append(sizes, 1)
  else list_transform(sizes, lambda n, k: case when k = far then greatest(n - 1, 1) else n end) end,
 cast(case act when 'move' then near - 1 when 'add' then len(centers) else far - 1 end as int)
from (select *, list_position(ds, list_min(ds)) as near, list_position(fs, list_max(fs)) as far, case when list_min(ds) <= 0.5 then 'move' when len(centers) < 5 then 'add' else 'far' end as act
 from (select w.rec, s.i, s.v, w.centers, w.sizes, list_transform(w.centers, lambda c: 1 - list_cosine_similarity(c, s.v)) as ds, list_transform(w.centers, lambda c: list_distance(c, s.v)) as fs from walk w join {source} s on s.rec = w.rec and s.i = w.i + 1)))"""


def _labels(rows: DataFrame, make) -> DataFrame:
    return cluster.online_labels(rows, ["rec"], make)


@query(f"{with_('emb', recursive=True)}, ordered as (select rec, chunk_idx as i, v from emb), {_kmeans('ordered')} select rec, i as chunk_idx, label as speaker from walk")
def q29_streaming_kmeans_cosine(spark, d):
    return _labels(b.chunk_embeddings(spark, d), lambda: cluster.OnlineMeans(0.5, 5))


def _relabelled(act: str, pick: str) -> str:
    """CTE walk(rec, i, centers, sizes, label) of Euclidean means whose labels are those after the change; ``pick`` gives or goes."""
    distances = lambda c: f"list_transform({c}, lambda c: list_distance(c, v))"
    return f"""ordered as (select rec, chunk_idx as i, v from emb), walk as (select rec, i, [v] as centers, [1] as sizes, 0 as label from ordered where i = 0
union all select rec, i, nc, ns, cast(list_position(nd, list_min(nd)) - 1 as int) from (select *, {distances('nc')} as nd from (select rec, i, v,
 case act when 'move' then list_transform(centers, lambda c, k: case when k = near then list_transform(c, lambda x, j: (x * sizes[near] + v[j]) / (sizes[near] + 1)) else c end) when 'add' then list_append(centers, v)
  when 'give' then list_transform(centers, lambda c, k: case when k = pick then list_transform(c, lambda x, j: (x * sizes[pick] - v[j]) / (sizes[pick] - 1)) else c end)
  when 'drop' then list_filter(centers, lambda c, k: k <> pick) else list_transform(centers, lambda c, k: case when k = pick then v else c end) end as nc,
 case act when 'move' then list_transform(sizes, lambda n, k: case when k = near then n + 1 else n end) when 'add' then list_append(sizes, 1)
  when 'give' then list_transform(sizes, lambda n, k: case when k = pick then n - 1 else n end) when 'drop' then list_filter(sizes, lambda n, k: k <> pick) else sizes end as ns
 from (select *, case when list_min(ds) <= 6 then 'move' {act} end as act from (select *, list_position(ds, list_min(ds)) as near, {pick} as pick
 from (select w.rec, s.i, s.v, w.centers, w.sizes, list_transform(w.centers, lambda c: list_distance(c, s.v)) as ds from walk w join ordered s on s.rec = w.rec and s.i = w.i + 1))))))"""


_BOUNDED = _relabelled("when len(centers) < 5 then 'add' when sizes[pick] > 1 then 'give' when len(centers) > 1 then 'drop' else 'swap'", "list_position(ds, list_max(ds))")
_UNBOUNDED = _relabelled("when sizes[pick] > 1 then 'give' else 'add'", "list_position(sizes, list_min(sizes))")


@query(f"{with_('emb', recursive=True)}, {_BOUNDED} select rec, i as chunk_idx, label as speaker from walk")
def q30_streaming_kmeans_euclid(spark, d):
    return _labels(b.chunk_embeddings(spark, d), lambda: cluster.OnlineMeans(6.0, 5, "euclidean", relabel=True))


@query(f"{with_('emb', recursive=True)}, {_UNBOUNDED} select rec, i as chunk_idx, label as speaker from walk")
def q31_kmeans_unbounded(spark, d):
    return _labels(b.chunk_embeddings(spark, d), lambda: cluster.UnboundedMeans(6.0))


@query()
def q33_agglomerative(spark, d):
    return cluster.agglomerative_labels(b.chunk_embeddings(spark, d), "rec", 0.6, 1, 8)


@query()
def q108_markov_speakers(spark, d):
    """Chunks of a recording as states of a hidden Markov model, whose size is searched for."""
    return cluster.markov_speakers(b.chunk_embeddings(spark, d), "rec", 1, 6)


@query(f"""{with_('emb', recursive=True)}, ordered as (select rec, chunk_idx as i, v from emb), walk as (select rec, i, [v] as centers, 0 as label from ordered where i = 0
union all select rec, i, case when list_max(ss) >= 0.75 then list_transform(centers, lambda c, k: case when k = near then list_transform(c, lambda x, j: (x + v[j]) / 2) else c end) else list_append(centers, v) end,
 cast(case when list_max(ss) >= 0.75 then near - 1 else len(centers) end as int) from (select *, list_position(ss, list_max(ss)) as near
 from (select w.rec, s.i, s.v, w.centers, list_transform(w.centers, lambda c: (1 + list_cosine_similarity(c, s.v)) / 2) as ss from walk w join ordered s on s.rec = w.rec and s.i = w.i + 1)))
select rec, i as chunk_idx, label as speaker from walk""")
def q32_speaker_similarity(spark, d):
    return _labels(b.chunk_embeddings(spark, d), lambda: cluster.SimilarSpeakers(0.75))


def _diarized(spark, d) -> DataFrame:
    """rec, chunk_idx, speaker: chunks long enough are clustered, the others take the nearest one's speaker."""
    rows = b.chunk_embeddings(spark, d)
    labels = _labels(rows.filter("n_samples >= 8000").select("rec", "chunk_idx", "v"), lambda: cluster.OnlineMeans(0.5, 5))
    return intervals.fill_nearest(rows.select("rec", "chunk_idx").join(labels, ["rec", "chunk_idx"], "left"), "rec", "chunk_idx", "speaker")


@query(f"""{with_('emb', recursive=True)}, valid as (select rec, chunk_idx, row_number() over (partition by rec order by chunk_idx) - 1 as i, v from emb where n_samples >= 8000), {_kmeans('valid')},
assigned as (select e.rec, e.chunk_idx, w.label as spk from emb e left join valid a on a.rec = e.rec and a.chunk_idx = e.chunk_idx left join walk w on w.rec = a.rec and w.i = a.i), {_FILL}
select rec, chunk_idx, speaker from filled""")
def q34_online_diarization(spark, d):
    return _diarized(spark, d).select("rec", "chunk_idx", "speaker")


# --- alignment


_TRELLIS = f"""{with_('em', recursive=True)}, utt as (select utt, list(e order by t) as es, list(cast(label as int) + 1 order by t) filter (where t < {b.TOKENS}) as toks from em group by utt),
tr as (select utt, 0 as t, list_prepend(0::double, list_transform(toks, lambda x: '-infinity'::double)) as r from utt
 union all select u.utt, tr.t + 1, list_transform(range(0, len(u.toks) + 1), lambda j: case when j = 0 then 0::double else greatest(tr.r[j + 1] + u.es[tr.t + 1][1], tr.r[j] + u.es[tr.t + 1][u.toks[j] + 1]) end) from tr join utt u using (utt) where tr.t < len(u.es)),
final as (select utt, list(r order by t) as m from tr group by utt),
ends as (select utt, m, list_position(list_transform(m, lambda r: r[len(r)]), list_max(list_transform(m, lambda r: r[len(r)]))) - 1 as k from final)"""


@query(f"{_TRELLIS} select utt, cast(k as int) as end_frame, m[k + 1][len(m[1])] as score from ends")
def q35_trellis(spark, d):
    return align.align_scores(*b.emissions(spark, d), "utt")


_PATH = f"""{_TRELLIS},
back as (select e.utt, k as t, len(u.toks) as j, e.m, u.es, u.toks, case when k > 0 then m[k][len(u.toks)] + es[k][toks[len(u.toks)] + 1] > m[k][len(u.toks) + 1] + es[k][1] end as moved from ends e join utt u using (utt)
 union all select utt, t - 1, j2, m, es, toks, m[t - 1][j2] + es[t - 1][toks[j2] + 1] > m[t - 1][j2 + 1] + es[t - 1][1] from (select *, j - case when moved then 1 else 0 end as j2 from back) where t > 1 and j2 > 0),
done as (select utt from back where moved and j = 1),
path as (select utt, cast(j - 1 as int) as token_index, cast(t - 1 as int) as time_index from back where t > 0 and utt in (select utt from done))"""


def _paths(spark, d) -> DataFrame:
    return align.align_paths(*b.emissions(spark, d), "utt")


@query(f"{_PATH} select utt, token_index, time_index from path")
def q36_viterbi_path(spark, d):
    return _paths(spark, d).select("utt", "token_index", "time_index")


@query(f"{_PATH} select utt, token_index, min(time_index) as start_t, max(time_index) + 1 as end_t from path group by utt, token_index")
def q37_run_merge(spark, d):
    return align.merge_repeats(_paths(spark, d), "utt").select("utt", "token_index", F.col("start").alias("start_t"), F.col("end").alias("end_t"))


@query(f"""{_PATH}, runs as (select utt, token_index, min(time_index) as s, max(time_index) + 1 as e from path group by utt, token_index),
marked as (select *, sum(case when token_index % 3 = 0 then 1 else 0 end) over w as g, lead(s) over w as nx from runs window w as (partition by utt order by token_index))
select utt, cast(row_number() over (partition by utt order by g) - 1 as int) as word_no, string_agg(cast(token_index as varchar), '' order by token_index) as text, min(s) as start_t, max_by(coalesce(nx, e), token_index) as end_t from marked where token_index % 3 <> 0 group by utt, g""")
def q37_word_merge(spark, d):
    runs = align.merge_repeats(_paths(spark, d), "utt").withColumn("label", F.when(F.col("token_index") % 3 == 0, "<star>").otherwise(F.col("token_index").cast("string")))
    return align.merge_words(runs, "utt", "label").select("utt", "word_no", "text", F.col("start").alias("start_t"), F.col("end").alias("end_t"))


_UTTERANCE_SAMPLES = "n_frames * 320 + utt % 320"


@query(f"""{_PATH}, scored as (select utt, j - 1 as token_index, t - 1 as time_index, exp(case when moved then es[t][toks[j] + 1] else es[t][1] end) as p from back where t > 0 and utt in (select utt from done)),
runs as (select utt, token_index, min(time_index) as s, max(time_index) + 1 as e, avg(p) as p from scored group by utt, token_index), sizes as (select utt, count(*) as n_frames, count(*) * 320 + utt % 320 as n_samples from em group by utt),
marked as (select *, sum(case when token_index % 3 = 0 then 1 else 0 end) over w as g, lead(s) over w as nx from runs window w as (partition by utt order by token_index)),
words as (select utt, g, string_agg(cast(token_index as varchar), '' order by token_index) as text, min(s) as s, max_by(coalesce(nx, e), token_index) as e, sum(p * (e - s)) / sum(e - s) as p from marked where token_index % 3 <> 0 group by utt, g)
select utt, cast(row_number() over (partition by utt order by g) - 1 as int) as word_no, text, cast(floor(s * (n_samples / 16000.0::double / n_frames) * 1000 + 0.5) as bigint) as start_ms, cast(floor(e * (n_samples / 16000.0::double / n_frames) * 1000 + 0.5) as bigint) as end_ms,
 cast(s as int) as start_t, cast(e as int) as end_t, cast(floor(p * 1000 + 0.5) as bigint) as score_milli, cast(floor(n_samples / 16000.0::double * 1000 + 0.5) as bigint) as length_ms from words join sizes using (utt)""")
def q110_word_seconds(spark, d):
    """The whole chain as served: paths, runs, words, then seconds, scores and the recording's length."""
    emissions, _ = b.emissions(spark, d)
    runs = align.merge_repeats(_paths(spark, d), "utt").withColumn("label", F.when(F.col("token_index") % 3 == 0, "<star>").otherwise(F.col("token_index").cast("string")))
    sizes = emissions.groupBy("utt").agg(F.count("*").alias("n_frames")).withColumn("n_samples", F.expr(_UTTERANCE_SAMPLES))
    return align.word_times(align.merge_words(runs, "utt", "label"), sizes, "utt")


@query(f"""{with_('em')}, x as (select utt, t, unnest(e) as x, unnest(range(len(e))) as feature from em) select utt, feature, cast(floor(avg(x) * 1000 + 0.5) as bigint) as mean_milli,
 cast(floor(sqrt(greatest(coalesce(var_samp(x), 0.0::double), 1e-10::double)) * 1000 + 0.5) as bigint) as deviation_milli from x where t < 1 + utt % 25 group by utt, feature""")
def q111_masked_statistics(spark, d):
    """Mean and deviation of each feature over the utterance's own length."""
    rows, _ = b.emissions(spark, d)
    x = rows.select("utt", "t", F.posexplode("logp").alias("feature", "x"))
    out = features.statistics_pool(x, ["utt", "feature"], "x", F.col("t"), 1 + F.col("utt") % 25)
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return out.select("utt", F.col("feature").cast("long").alias("feature"), milli("mean").alias("mean_milli"), milli("deviation").alias("deviation_milli"))


def _conv_sql(n: str) -> str:
    for kernel, stride in align.CONVOLUTIONS:
        n = f"(cast(floor(({n} - {kernel}) / {stride}) as bigint) + 1)"
    return n


@query(f"select doc_id, n_chars * 160 as n_samples, cast(ceil(n_chars * 160 / 480000) as bigint) as n_windows, greatest(0, {_conv_sql('n_chars * 160')}) as model_frames, n_chars * 160 // 160 + 1 as stft_frames, (480000 - (n_chars * 160) % 480000) % 480000 as extension from documents")
def q38_emission_windowing(spark, d):
    n = F.col("n_chars") * 160
    return table(spark, d, "documents").select("doc_id", n.alias("n_samples"), F.ceil(n / 480000).alias("n_windows"), align.convolved(n).alias("model_frames"), (F.floor(n / 160) + 1).alias("stft_frames"), ((480000 - n % 480000) % 480000).alias("extension"))


# --- features


@query(f"""{with_('emb')}, x as (select rec, chunk_idx, unnest(v) as x, unnest(range(len(v))) as feature from emb), s as (select rec, feature, avg(x) as m, stddev_samp(x) as sd from x group by rec, feature)
select rec, chunk_idx, cast(feature as int) as feature, cast(floor((x - m) / (sd + 1e-5) * 1000 + 0.5) as bigint) as z_milli from x join s using (rec, feature)""")
def q39_normalize_features(spark, d):
    x = b.chunk_embeddings(spark, d).select("rec", "chunk_idx", F.posexplode("v").alias("feature", "x"))
    z = features.normalized(x, ["rec", "feature"], "x", "z")
    return z.select("rec", "chunk_idx", "feature", F.floor(F.col("z") * 1000 + 0.5).cast("long").alias("z_milli"))


@query(f"""{with_('frames')}, p as (select stream_id, frame_no, case when lag(value) over w is null then value else value - 0.97::double * lag(value) over w end as x from frames window w as (partition by stream_id order by frame_no))
select stream_id, frame_no, cast(floor(x * 1000 + 0.5) as bigint) as x0, cast(floor(lead(x, 1) over w * 1000 + 0.5) as bigint) as x1, cast(floor(lead(x, 2) over w * 1000 + 0.5) as bigint) as x2 from p window w as (partition by stream_id order by frame_no) qualify lead(frame_no, 2) over w is not null""")
def q40_preemphasis_splice(spark, d):
    p = features.pre_emphasis(b.frames(spark, d), "stream_id", "frame_no", "value", "x")
    milli = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    return features.splice(p, "stream_id", "frame_no", "x", "xs", 3).select("stream_id", "frame_no", *(milli(F.col("xs")[i]).alias(f"x{i}") for i in range(3)))


@query(f"""with w as (select doc_id, doc_id // 16 as batch, list_transform({_WORDS}, lambda w: length(w)) as a from documents), n as (select batch, max(len(a)) as n from w group by batch)
select doc_id, batch, len(a) as n_valid, n as n_padded, md5(array_to_string(list_concat(a, list_transform(range(n - len(a)), lambda i: 0)), ',')) as padded_md5 from w join n using (batch)""")
def q41_pad_batch(spark, d):
    lengths = F.transform(normalize.words_of(F.lower(F.coalesce("text", F.lit("")))), lambda w: F.length(w))
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), lengths.alias("a"))
    rows = rows.join(rows.groupBy("batch").agg(F.max(F.size("a")).cast("long").alias("n_padded")), "batch")
    padded = features.padded(F.col("a"), F.col("n_padded"), F.lit(0))
    return rows.select("doc_id", "batch", F.size("a").cast("long").alias("n_valid"), "n_padded", F.md5(F.array_join(padded, ",")).alias("padded_md5"))


@query()
def q56_mel_spectrogram(spark, d):
    mel = features.log_mel_of_streams(b.frames(spark, d), "stream_id", "frame_no", "value", 16_000, n_fft=32, hop=16, n_mels=8, piece=512)
    return mel.select("stream_id", "part", "frame", F.floor(F.aggregate("mel", F.lit(0.0), lambda a, x: a + x) * 1000).cast("long").alias("mel_milli"))


# --- reports


def _requests(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", report.cents(F.col("o_totalprice")).alias("latency"))


def _report_sql(key: str, source: str, value: str) -> str:
    """Percentiles by place: the int(q*n)-th smallest, or the largest where there are too few."""
    at = lambda q, least: f"case when count(*) >= {least} then (list_sort(list({value})))[greatest(1, cast(floor({q}::double * count(*)) as bigint))] else max({value}) end"
    return f"select {key}, count(*) as n, min({value}) as least, max({value}) as most, cast(sum({value}) as bigint) as total, (list_sort(list({value})))[(count(*) + 1) // 2] as p50, {at(0.90, 10)} as p90, {at(0.95, 20)} as p95, {at(0.99, 100)} as p99 from {source} group by {key}"


_CENTS = "cast(floor(o_totalprice * 100 + 0.5) as bigint)"


@query(_report_sql("o_orderpriority", f"(select o_orderpriority, {_CENTS} as latency from orders where o_orderstatus <> 'P')", "latency"))
def q42_latency_report(spark, d):
    return report.order_statistics(_requests(spark, d).filter("o_orderstatus <> 'P'"), ["o_orderpriority"], "latency")


@query(_report_sql("event_type", "(select event_type, cast(floor(value * 100 + 0.5) as bigint) as ttft from events)", "ttft"))
def q43_ws_report(spark, d):
    return report.order_statistics(table(spark, d, "events").select("event_type", report.cents(F.col("value")).alias("ttft")), ["event_type"], "ttft")


@query(f"select lang, count(*) as requests, cast(sum(len({_WORDS})) as bigint) as n_words, cast(sum(n_chars) as bigint) as audio_cs, cast(floor(cast(sum(len({_WORDS})) as double) / count(*) * 100 + 0.5) as bigint) as words_per_request_centi from documents group by lang")
def q44_align_report(spark, d):
    n = F.size(normalize.words_of(F.lower(F.coalesce("text", F.lit("")))))
    out = table(spark, d, "documents").select("lang", "n_chars", n.alias("w")).groupBy("lang").agg(F.count("*").alias("requests"), F.sum("w").alias("n_words"), F.sum("n_chars").alias("audio_cs"))
    return out.withColumn("words_per_request_centi", F.floor(F.col("n_words").cast("double") / F.col("requests") * 100 + 0.5).cast("long"))


_COUNTS = "select '{0}' as method, count(*) as n_chunks, cast(sum(n_silent) as bigint) as n_silent, cast(sum(n_samples) as bigint) as n_samples from chunks"


@query(f"select * from ({_walk()} {_COUNTS.format('sequential')}) union all select * from ({_walk(4)} {_COUNTS.format('parallel')})")
def q45_vad_benchmark(spark, d):
    both = _chunks(spark, d).withColumn("method", F.lit("sequential")).unionByName(q03_vad_parallel(spark, d).drop("part").withColumn("method", F.lit("parallel")))
    return both.groupBy("method").agg(F.count("*").alias("n_chunks"), F.sum("n_silent").alias("n_silent"), F.sum("n_samples").alias("n_samples"))


@query(f"select n_name, o_orderpriority, count(*) as requests, cast(sum({_CENTS}) as bigint) as total_cents from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name, o_orderpriority")
def q46_usage_ledger(spark, d):
    ledger = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return ledger.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("requests"), F.sum(report.cents(F.col("o_totalprice"))).alias("total_cents"))


@query(f"select o_custkey, cast(date_trunc('day', o_orderdate) as varchar)[1:10] as day, count(*) as used, greatest(0, 5 - count(*)) as remaining, cast(sum({_CENTS}) as bigint) as spent from orders group by all")
def q47_quota_window(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    out = table(spark, d, "orders").groupBy("o_custkey", day).agg(F.count("*").alias("used"), F.sum(report.cents(F.col("o_totalprice"))).alias("spent"))
    return out.withColumn("remaining", F.greatest(F.lit(0), 5 - F.col("used")).cast("long"))


@query("select s_nationkey, min_by(s_name, s_suppkey) filter (where s_acctbal > 0) as host from supplier group by s_nationkey")
def q48_first_available_host(spark, d):
    rows = table(spark, d, "supplier").withColumnRenamed("s_name", "host")
    return report.first_of(rows, "s_nationkey", "s_suppkey", "host", F.col("s_acctbal") > 0)


@query(f"""{with_('frames', recursive=True)}, ema as (select stream_id, frame_no, value as x, value from frames where frame_no = 0 union all
 select f.stream_id, f.frame_no, e.x + 0.5::double * (f.value - e.x), f.value from ema e join frames f on f.stream_id = e.stream_id and f.frame_no = e.frame_no + 1)
select stream_id, frame_no, case when value < 30 and x < 32 then 'silent' else 'active' end as token from ema""")
def q101_live_tokens(spark, d):
    """A frame is silent only if both its score and the smoothed volume are low."""
    frames = b.frames(spark, d)
    values = frames.select("stream_id", F.col("frame_no").alias("item"), "value")
    smooth = folds.fold(values, ["stream_id"], ["item"], ["value"], lambda: folds.Smoothing(0.5), "frame_no long, x double")
    quiet = (F.col("value") < 30) & (F.col("x") < 32)
    return frames.join(smooth, ["stream_id", "frame_no"]).select("stream_id", "frame_no", F.when(quiet, "silent").otherwise("active").alias("token"))


@query(f"""{_walk()} select stream_id, chunk_idx, md5(cast(case when silence_ratio > {b.REJECT} then json_object('type', 'silent') else json_object('type', 'transcription', 'start_sample', start_frame * {b.FRAME}, 'end_sample', end_frame * {b.FRAME}) end as varchar)) as message_md5 from chunks""")
def q102_json_messages(spark, d):
    """Messages as they leave: JSON objects without the members that are missing."""
    spoken = F.col("silence_ratio") <= b.REJECT
    members = [F.when(spoken, "transcription").otherwise("silent").alias("type"), *(F.when(spoken, F.col(f"{c}_frame") * b.FRAME).alias(f"{c}_sample") for c in ("start", "end"))]
    chunks = _chunks(spark, d)
    return audio.messages_json(chunks.select("stream_id", "chunk_idx", *members), ["type", "start_sample", "end_sample"], keep=["stream_id", "chunk_idx"]).select("stream_id", "chunk_idx", F.md5("value").alias("message_md5"))


_DAY = 86_400_000_000


@query(f"""with recursive a as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, epoch_us(ts) as us from events),
walk as (select user_id, event_id, i, 0 as batch, 1 as n, us as began from a where i = 0
 union all select user_id, event_id, i, batch + fresh, case when fresh = 1 then 1 else n + 1 end, case when fresh = 1 then us else began end
 from (select a.user_id, a.event_id, a.i, a.us, w.batch, w.n, w.began, case when w.n = 8 or a.us - w.began > {_DAY} then 1 else 0 end as fresh from walk w join a on a.user_id = w.user_id and a.i = w.i + 1))
select user_id, event_id, batch from walk""")
def q51_micro_batches(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return folds.fold(rows, ["user_id"], ["at", "item"], [], lambda: folds.MicroBatches(8, _DAY), "event_id long, batch int")


@query("""select event_id, try_cast(props->>'$.k' as bigint) as k, coalesce(case when event_id % 3 = 0 then event_type end, case when event_id % 3 = 1 then event_type end, 'raw') as detail from events""")
def q52_json_probe(spark, d):
    body = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("detail")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.struct(F.col("event_type").alias("message")).alias("error")))).otherwise("raw")
    message = F.coalesce(F.get_json_object("body", "$.detail"), F.get_json_object("body", "$.error.message"), F.col("body"))
    return table(spark, d, "events").withColumn("body", body).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), message.alias("detail"))


@query("select o_orderstatus, n, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as first_ids from (select o_orderstatus, o_orderkey, count(*) over (partition by o_orderstatus) as n, row_number() over (partition by o_orderstatus order by o_orderkey) as k from orders) where k <= 5 group by o_orderstatus, n")
def q53_error_counts(spark, d):
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    ids = report.first_k(orders, "o_orderstatus", "o_orderkey", 5).groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("first_ids"))
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(ids, "o_orderstatus")


@query(f"{_walk()} select stream_id, chunk_idx, case when silence_ratio > {b.REJECT} then 'silent' else 'transcription' end as type, start_frame * {b.FRAME} as start_sample, end_frame * {b.FRAME} as end_sample from chunks")
def q54_messages(spark, d):
    kind = F.when(F.col("silence_ratio") > b.REJECT, "silent").otherwise("transcription")
    return _chunks(spark, d).select("stream_id", "chunk_idx", kind.alias("type"), (F.col("start_frame") * b.FRAME).alias("start_sample"), (F.col("end_frame") * b.FRAME).alias("end_sample"))


@query(f"""with w as (select doc_id, {_WORDS} as a from documents), x as (select doc_id, a, unnest(range(0, (len(a) + 19) // 20)) as k from w)
select doc_id, k as window_no, greatest(0, k * 20 - 20) as start_word, least(len(a), (k + 1) * 20) as end_word, md5(array_to_string(a[greatest(0, k * 20 - 20) + 1 : least(len(a), (k + 1) * 20)], ' ')) as words_md5 from x""")
def q55_speech_token_windows(spark, d):
    words = normalize.words_of(F.lower(F.coalesce("text", F.lit(""))))
    rows = table(spark, d, "documents").select("doc_id", words.alias("a")).filter(F.size("a") > 0)
    # windows are cut before they become rows, so no row holds the whole array beside its window
    start, end = (lambda k: F.greatest(F.lit(0), k * 20 - 20)), (lambda a, k: F.least(F.size(a), (k + 1) * 20))
    window = lambda k: F.struct(k.alias("k"), start(k).alias("start"), end(F.col("a"), k).alias("end"), F.md5(F.array_join(F.slice("a", start(k) + 1, end(F.col("a"), k) - start(k)), " ")).alias("md5"))
    rows = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("a") - 1) / 20).cast("int")), window)).alias("w"))
    return rows.select("doc_id", F.col("w.k").cast("long").alias("window_no"), F.col("w.start").cast("long").alias("start_word"), F.col("w.end").cast("long").alias("end_word"), F.col("w.md5").alias("words_md5"))


# --- scalars


_CLOCK = "printf('%s%02d:%02d:%02d.%03d', case when m < 0 then '-' else ' ' end, cast(abs(m) // 3600000 as int), cast(abs(m) // 60000 % 60 as int), cast(abs(m) // 1000 % 60 as int), cast(abs(m) % 1000 as int))"


@query(f"{with_('seg', 'shifted')}, x as (select conv_id, pos, s * 10 as m, e - s as width from shifted) select conv_id, pos, {_CLOCK} as clock, cast(floor(greatest(0.0::double, least(1.0::double, (width - 100.0::double) / 500.0::double)) * 1000 + 0.5) as bigint) as share_milli from x")
def q57_scalar_formats(spark, d):
    share = scalars.clamped_share((F.col("e") - F.col("s")).cast("double"), 100.0, 600.0)
    return b.shifted(spark, d).select("conv_id", "pos", scalars.clock(F.col("s") * 10).alias("clock"), F.floor(share * 1000 + 0.5).cast("long").alias("share_milli"))


@query("""with p as (select event_type, max(abs(value)) as top from events group by event_type), x as (select event_id, cast(trunc(value / top * 32768) as bigint) + 32768 as n from events join p using (event_type))
select event_id, cast((n % 65536 + 65536) % 65536 - 32768 as int) as pcm from x""")
def q58_peak_int16(spark, d):
    events = table(spark, d, "events")
    top = events.groupBy("event_type").agg(F.max(F.abs("value")).alias("top"))
    return events.join(top, "event_type").select("event_id", scalars.int16_wrapped(F.col("value") / F.col("top")).alias("pcm"))


@query(f"select doc_id, len({_WORDS}) as n_tokens, cast(coalesce(list_sum(list_transform({_WORDS}, lambda w: length(w))), 0) as bigint) as total from documents")
def q59_codec_tokens(spark, d):
    words = normalize.words_of(F.lower(F.coalesce("text", F.lit(""))))
    coded = F.array_join(F.transform(words, lambda w: F.concat(F.lit("<|s_"), F.length(w), F.lit("|>"))), "")
    ids = scalars.codec_tokens(coded)
    return table(spark, d, "documents").select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"select conv_id, turn, cast(list_has_any({_WORDS}, ['system', 'the', 'und']) as int) as blocked, cast(length(coalesce(text, '')) <= 1000 as int) as short_enough from conversations")
def q60_prompt_guard(spark, d):
    words = normalize.words_of(F.lower(F.coalesce("text", F.lit(""))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.arrays_overlap(words, F.array(*map(F.lit, ("system", "the", "und")))).cast("int").alias("blocked"), (F.length(F.coalesce("text", F.lit(""))) <= 1000).cast("int").alias("short_enough"))


# --- the flagship


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, duration, text, segments: each conversation's segments with the speaker of the largest overlap.

    A segment that overlaps no turn takes the speaker of the nearest segment that does.
    """
    found = intervals.best_overlap(b.segments(spark, d), b.turns(spark, d), "conv_id", "turn")
    known = found.select("conv_id", "turn", F.when(F.col("speaker").isNotNull(), intervals.speaker_number(F.col("speaker"))).alias("speaker"))
    rows = b.segments(spark, d).join(intervals.fill_nearest(known, "conv_id", "turn", "speaker"), ["conv_id", "turn"])
    one = F.struct("turn", (F.col("s") / 100).alias("start"), (F.col("e") / 100).alias("end"), F.col("t").alias("text"), "speaker")
    segments = F.array_sort(F.collect_list(one)).alias("segments")
    return rows.groupBy("conv_id").agg((F.max_by("e", "turn") / 100).alias("duration"), _joined(" ").alias("text"), segments)


from turnstream.plans import requests, signals, streams  # noqa: E402, F401  they register their queries
