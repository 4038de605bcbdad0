"""Queries of features, windows, scores and intervals, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstream.functions import normalize, scalars
from turnstream.operators import align, cluster, features, intervals, loudness, sentences
from turnstream.plans import bindings as b
from turnstream.plans.bindings import table, with_
from turnstream.plans.registry import query
from turnstream.sources import audio


def _milli(c):
    return F.floor(c * 1000 + 0.5).cast("long")


_X = "x as (select rec, chunk_idx, n_samples, unnest(v) as x, unnest(range(len(v))) as feature from emb)"


def _exploded(spark, d):
    return b.chunk_embeddings(spark, d).select("rec", "chunk_idx", "n_samples", F.posexplode("v").alias("feature", "x"))


@query(f"""{with_('emb')}, {_X}, w as (select rec, sum(n_samples)::double as total from emb group by rec), m as (select rec, feature, sum(n_samples / total * x) as mean from x join w using (rec) group by rec, feature)
 select rec, cast(feature as int) as feature, cast(floor(any_value(mean) * 1000 + 0.5) as bigint) as mean_milli, cast(floor(sqrt(greatest(sum(n_samples / total * (x - mean) * (x - mean)), 1e-10::double)) * 1000 + 0.5) as bigint) as deviation_milli from x join w using (rec) join m using (rec, feature) group by rec, feature""")
def q83_masked_statistics(spark, d):
    rows = _exploded(spark, d)
    total = b.chunk_embeddings(spark, d).groupBy("rec").agg(F.sum("n_samples").cast("double").alias("total"))
    weighted = rows.join(total, "rec").withColumn("w", F.col("n_samples") / F.col("total"))
    return features.masked_statistics(weighted, ["rec", "feature"], "x", "w").select("rec", "feature", _milli(F.col("mean")).alias("mean_milli"), _milli(F.col("deviation")).alias("deviation_milli"))


@query(f"""{with_('emb')}, {_X}, s as (select rec, avg(x) as m, stddev_samp(x) as sd from x group by rec)
 select rec, chunk_idx, cast(floor(sum((x - m) / (sd + 1e-5)) * 1000 + 0.5) as bigint) as all_milli, cast(floor(sum((x - 0.25::double) / 2.0::double) * 1000 + 0.5) as bigint) as fixed_milli from x join s using (rec) group by rec, chunk_idx""")
def q84_normalize_overall(spark, d):
    """One mean for all features of a recording, and given ones."""
    z = features.normalized(_exploded(spark, d), ["rec"], "x", "all")
    z = features.normalized_fixed(z, "x", "fixed", F.lit(0.25), F.lit(2.0))
    return z.groupBy("rec", "chunk_idx").agg(_milli(F.sum("all")).alias("all_milli"), _milli(F.sum("fixed")).alias("fixed_milli"))


@query(f"""{with_('em')}, u as (select utt, list(e[1] order by t) as s, count(*) as n from em group by utt), p as (select utt, s, n, unnest(range(n // 5)) as k from u)
 select utt, k as span, k * 100 as start_ms, (k * 5 + 4) * 20 as end_ms, cast(floor(list_sum(s[k * 5 + 1 : k * 5 + 4]) * 1000 + 0.5) as bigint) as score_milli from p""")
def q85_span_scores(spark, d):
    """Spans of frames with their times and summed scores."""
    rows, _ = b.emissions(spark, d)
    s = F.transform(F.array_sort(F.collect_list(F.struct("t", F.get("logp", F.lit(0)).alias("x")))), lambda r: r["x"])
    u = rows.groupBy("utt").agg(s.alias("s"))
    spans = F.filter(F.sequence(F.lit(0), F.floor(F.size("s") / 5).cast("int")), lambda k: (k + 1) * 5 <= F.size("s"))
    each = F.transform(spans, lambda k: F.struct(k.cast("long").alias("span"), features.span_sum(F.col("s"), k * 5, k * 5 + 4).alias("score")))
    return u.select("utt", F.explode(each).alias("x")).select("utt", "x.span", (F.col("x.span") * 100).alias("start_ms"), ((F.col("x.span") * 5 + 4) * 20).alias("end_ms"), _milli(F.col("x.score")).alias("score_milli"))


@query(f"{with_('emb')}, {_X} select rec, cast(feature as int) as feature, cast(floor(max(x) * 1000 + 0.5) as bigint) as most_milli, cast(floor(avg(x) * 1000 + 0.5) as bigint) as average_milli from x group by rec, feature")
def q86_pooled(spark, d):
    return features.pooled(_exploded(spark, d), ["rec", "feature"], "x").select("rec", "feature", _milli(F.col("most")).alias("most_milli"), _milli(F.col("average")).alias("average_milli"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x, i: {'x': -x::double, 'i': i - 1}) as a from embeddings) select vec_id, cast((list_sort(a))[1].i as int) as label, array_to_string(list_transform((list_sort(a))[1:3], lambda r: r.i), ',') as first_three,
 cast(case when -(list_sort(a))[1].x >= 1.5 then (list_sort(a))[1].i else -1 end as int) as over_threshold from e""")
def q87_labels(spark, d):
    """The best label, the three best ones, and the best one over a threshold."""
    scores = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.get(cluster.top_k(scores, 1), F.lit(0)).alias("label"), F.array_join(cluster.top_k(scores, 3), ",").alias("first_three"), F.coalesce(cluster.top_over(scores, 1.5), F.lit(-1)).alias("over_threshold"))


@query(f"""{with_('emb', recursive=True)}, c as (select rec, list(v order by chunk_idx) as cs from emb where chunk_idx < 5 group by rec), s as (select rec, chunk_idx, list_transform(cs, lambda c: (list_cosine_similarity(c, v) + 1) / 2) as s from emb join c using (rec))
 select rec, chunk_idx, cast(case when list_max(s) >= 0.6 then list_position(s, list_max(s)) - 1 else -1 end as int) as speaker from s""")
def q88_top_speaker(spark, d):
    """Of a recording's first five voices the most similar one, if it is similar enough."""
    rows = b.chunk_embeddings(spark, d)
    voices = rows.filter("chunk_idx < 5").groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "v"))), lambda r: r["v"]).alias("voices"))
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    similar = F.transform("voices", lambda c: (dot(c, F.col("v")) / F.sqrt(dot(c, c) * dot(F.col("v"), F.col("v"))) + 1) / 2)
    return rows.join(voices, "rec").select("rec", "chunk_idx", F.coalesce(cluster.top_over(similar, 0.6), F.lit(-1)).alias("speaker"))


@query(f"""{with_('em')}, u as (select utt, list(cast(floor(e[1] * 1000) as bigint) order by t) as a from em where t < 11 + utt % 14 group by utt), p as (select utt, a, cast(ceil(len(a) / 10.0::double) as bigint) * 10 - len(a) as more from u),
 w as (select utt, a, more, list_concat([0, 0], a, list_transform(range(more + 2), lambda i: 0))[1:14] as win from p), f as (select *, win[3 : len(win) - 1] as own from w)
 select utt, len(a) as n_samples, more as extension, len(win) as n_window, md5(array_to_string(win, ',')) as window_md5, md5(array_to_string(own[1 : greatest(0, len(own) - more)], ',')) as kept_md5 from f""")
def q89_emission_windows(spark, d):
    """The first window of ten values with two of context, cut, and its frames without context and extension."""
    rows, _ = b.emissions(spark, d)
    s = F.transform(F.array_sort(F.collect_list(F.struct("t", F.floor(F.get("logp", F.lit(0)) * 1000).cast("double").alias("x")))), lambda r: r["x"])
    u = rows.filter(F.col("t") < 11 + F.col("utt") % 14).groupBy("utt").agg(s.alias("a"))
    u = u.withColumn("win", align.emission_window(F.col("a"), 10, 2))
    n = F.size("a")
    kept = align.trimmed_frames(F.col("win"), n, 10, 1, 2, 1)
    text = lambda a: F.md5(F.array_join(F.transform(a, lambda x: x.cast("long")), ","))
    return u.select("utt", n.cast("long").alias("n_samples"), (F.ceil(n / 10) * 10 - n).alias("extension"), F.size("win").cast("long").alias("n_window"), text(F.col("win")).alias("window_md5"), text(kept).alias("kept_md5"))


@query(f"{with_('seg')} select conv_id, turn, e - s as duration, s + e as middle_x2, cast(e > s as int) as filled, cast(s <= turn * 300 and turn * 300 <= e as int) as overlaps from seg")
def q90_interval_points(spark, d):
    p = intervals.points(F.col("s"), F.col("e"), F.col("turn") * 300)
    return b.segments(spark, d).select("conv_id", "turn", *[(c.cast("int") if n in ("filled", "overlaps") else c).alias(n) for n, c in p.items()])


@query(f"""{with_('seg')}, p as (select conv_id, turn, list_filter(case when conv_id % 3 = 0 then string_split(t, '') else string_split_regex(t, '\\s+') end, lambda w: w <> '') as a from seg)
 select conv_id, turn, case when conv_id % 3 = 2 then len(a) + 2 else 2 * len(a) end as n_tokens, md5(coalesce(case when conv_id % 3 = 2 then array_to_string(list_concat(['<star>'], a, ['<star>']), '|') else array_to_string(list_transform(a, lambda x: '<star>|' || x), '|') end, '')) as texts_md5 from p""")
def q91_preprocess_text(spark, d):
    """A third in Japanese (by character), in English with a star before each word, and with stars at the edges."""
    rows = b.segments(spark, d).select("conv_id", "turn", "t")
    of = lambda k, *a: normalize.preprocess_text(rows.filter(F.col("conv_id") % 3 == k), "t", ["conv_id", "turn"], *a)
    out = of(0, "jpn").unionByName(of(1, "eng", "word", "segment")).unionByName(of(2, "eng", "word", "edges"))
    return out.select("conv_id", "turn", F.size("texts").cast("long").alias("n_tokens"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


@query(f"""{with_('em')}, u as (select utt, list(e[1] order by t) as a from em group by utt) select utt, cast(floor(greatest(0.0::double, least(1.0::double, (10 * log10(list_avg(list_transform(a, lambda x: (x / list_max(list_transform(a, lambda y: abs(y)))) * (x / list_max(list_transform(a, lambda y: abs(y))))))) + 20) / 100)) * 1000 + 0.5) as bigint) as share_milli from u""")
def q92_loudness(spark, d):
    rows, _ = b.emissions(spark, d)
    s = F.transform(F.array_sort(F.collect_list(F.struct("t", F.get("logp", F.lit(0)).alias("x")))), lambda r: r["x"])
    return rows.groupBy("utt").agg(s.alias("a")).select("utt", _milli(features.loudness_share(F.col("a"))).alias("share_milli"))


@query(f"""{with_('seg')}, w as (select conv_id, list(string_split_regex(trim(t), '\\s+') order by turn) as a, max(len(string_split_regex(trim(t), '\\s+'))) as most, count(*) as n from seg group by conv_id)
 select conv_id, n + 1 as n_rows, md5(array_to_string(list_append(list_transform(a, lambda r: array_to_string(list_concat(r, list_transform(range(most - len(r)), lambda i: '-')), ',')), array_to_string(list_transform(range(most), lambda i: '-'), ',')), '|')) as padded_md5 from w""")
def q93_padded_square(spark, d):
    """The words of a conversation's turns, padded to its longest turn and one row more than it has."""
    words = F.split(F.trim("t"), r"\s+")
    a = F.transform(F.array_sort(F.collect_list(F.struct("turn", words.alias("w")))), lambda r: r["w"])
    rows = b.segments(spark, d).groupBy("conv_id").agg(a.alias("a"), F.max(F.size(words)).alias("most"))
    wide = F.transform("a", lambda r: features.padded(r, F.col("most"), F.lit("-")))
    whole = features.padded(wide, F.size("a") + 1, F.array_repeat(F.lit("-"), F.col("most")))
    return rows.select("conv_id", (F.size("a") + 1).cast("long").alias("n_rows"), F.md5(F.array_join(F.transform(whole, lambda r: F.array_join(r, ",")), "|")).alias("padded_md5"))


def _signals(spark, d):
    rows, _ = b.emissions(spark, d)
    s = F.transform(F.array_sort(F.collect_list(F.struct("t", F.get("logp", F.lit(0)).alias("x")))), lambda r: r["x"])
    return rows.groupBy("utt").agg(s.alias("samples"))


@query()
def q94_mfcc(spark, d):
    out = features.mfcc(_signals(spark, d), ["utt"], "samples", 16_000, 4, n_fft=16, hop=8, n_mels=6)
    return out.select("utt", "frame", _milli(F.get("mfcc", F.lit(0))).alias("first_milli"))


@query()
def q95_mel_clamped(spark, d):
    out = features.log_mel_clamped(_signals(spark, d), ["utt"], "samples", 16_000, n_fft=16, hop=8, n_mels=6)
    return out.select("utt", "frame", _milli(F.get("mel", F.lit(0))).alias("first_milli"))


@query(f"{with_('seg')} select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as place, md5(t) as text_md5, s as start_cs from seg")
def q96_chunks_with_results(spark, d):
    """Results and chunks of a request belong together by their place."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col(c).alias("x")))), lambda r: r["x"])
    rows = b.segments(spark, d).groupBy("conv_id").agg(ordered("t").alias("results"), ordered("s").alias("chunks"))
    return rows.select("conv_id", F.posexplode(align.zipped(F.col("results"), F.col("chunks"))).alias("place", "p")).select("conv_id", "place", F.md5("p.a").alias("text_md5"), F.col("p.b").alias("start_cs"))


@query(f"""{with_('em')}, x as (select utt, t, list_transform(e, lambda x: x - list_max(e) - ln(list_sum(list_transform(e, lambda y: exp(y - list_max(e)))))) as l from em)
 select utt, cast(t as int) as t, len(l) + 1 as width, cast(floor(l[1] * 1000 + 0.5) as bigint) as first_milli, cast(floor(list_min(l) * 1000 + 0.5) as bigint) as least_milli from x""")
def q97_log_softmax_star(spark, d):
    rows, _ = b.emissions(spark, d)
    soft = rows.select("utt", "t", align.log_softmax_star(F.col("logp")).alias("l"))
    return soft.select("utt", "t", F.size("l").cast("long").alias("width"), _milli(F.get("l", F.lit(0))).alias("first_milli"), _milli(F.array_min("l")).alias("least_milli"))


@query(f"""{with_('em')}, u as (select utt, list(e[1] / 2 order by t) as a from em group by utt),
 w as (select utt, list_transform(a, lambda x, i: cast(trunc(greatest(-1.0::double, least(1.0::double, x)) * case when len(a) > 5 and i > len(a) - 5 then (len(a) - i) / 4.0::double else 1 end * 32767) as int)) as s, a from u)
 select utt, list_sum(s)::bigint as total, s[len(s)] as last, cast(floor(list_sum(list_transform(a, lambda x: pow(10.0::double, least(x, 5.0::double)))) * 1000 + 0.5) as bigint) as power_milli from w""")
def q98_wire_samples(spark, d):
    """Samples clipped, faded out over the last five and written as 16 bits; and powers of ten of logarithms."""
    u = _signals(spark, d).select("utt", F.transform("samples", lambda x: x / 2).alias("a"))
    s = scalars.faded_int16(F.col("a"), 5)
    add = lambda a, zero: F.aggregate(a, zero, lambda t, x: t + x)
    powers = F.transform("a", lambda x: scalars.from_log(x))
    return u.withColumn("s", s).select("utt", add(F.col("s"), F.lit(0).cast("int")).cast("long").alias("total"), F.element_at("s", -1).alias("last"), _milli(add(powers, F.lit(0.0))).alias("power_milli"))


# --- resampling

_FROM, _TO, _ZEROS = 3, 2, 4
_BAND = audio.ROLL_OFF * _TO / _FROM
_AWAY = f"(n * {_FROM} / {_TO}::double - j)"
_TAP = f"""case when abs({{0}} * {_BAND} / {_ZEROS}) < 1 then (case when {{0}} = 0 then 1 else sin(pi() * {{0}} * {_BAND}) / (pi() * {{0}} * {_BAND}) end)
 * (0.42::double + 0.5::double * cos(pi() * {{0}} * {_BAND} / {_ZEROS}) + 0.08::double * cos(2 * pi() * {{0}} * {_BAND} / {_ZEROS})) else 0 end"""


@query(f"""{with_('frames')}, u as (select stream_id, count(*) as n_in from frames group by stream_id), o as (select stream_id, n_in, unnest(range((n_in * {_TO} + {_FROM - 1}) // {_FROM})) as n from u),
 t as (select stream_id, n_in, n, unnest(range(n * {_FROM} // {_TO} - 12, n * {_FROM} // {_TO} + 14)) as j from o), w as (select *, {_TAP.format(_AWAY)} as tap from t)
 select w.stream_id, w.n as sample_no, cast(floor(sum(tap * coalesce(value, 0)) / sum(tap) * 1000 + 0.5) as bigint) as value_milli from w left join frames f on f.stream_id = w.stream_id and f.frame_no = w.j group by w.stream_id, w.n""")
def q106_resampled(spark, d):
    """Each stream's values as a signal at two thirds of its rate."""
    signal = F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "value"))), lambda r: r["value"])
    streams = b.frames(spark, d).groupBy("stream_id").agg(signal.alias("x"))
    out = streams.select("stream_id", F.posexplode(audio.resampled(F.col("x"), _FROM, _TO, _ZEROS)).alias("sample_no", "y"))
    return out.select("stream_id", F.col("sample_no").cast("long").alias("sample_no"), _milli(F.col("y")).alias("value_milli"))


# --- sentences


@query()
def q107_sentences(spark, d):
    """Turns cut into sentences by a model of all turns."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = sentences.split_sentences(rows, sentences.train(rows), "text", ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "|")).alias("sentences_md5"))


# --- loudness, numbers and scripts


_RATE = 16_000
_STAGE = [(*(repr(float(v)) for v in b_), *(repr(float(v)) for v in a_[1:])) for b_, a_ in loudness.weighting(_RATE)]


@query(f"""{with_('frames', recursive=True)}, p as (select stream_id, frame_no as i, value / max(abs(value)) over (partition by stream_id) as x from frames),
 walk as (select stream_id, -1::bigint as i, 0::double as x1, 0::double as x2, 0::double as y1, 0::double as y2, 0::double as z1, 0::double as z2 from p where i = 0
 union all select stream_id, i, x, x1, y, y1, {_STAGE[1][0]}::double * y + {_STAGE[1][1]}::double * y1 + {_STAGE[1][2]}::double * y2 - ({_STAGE[1][3]}::double) * z1 - ({_STAGE[1][4]}::double) * z2, z1
 from (select p.stream_id, p.i, p.x, w.*exclude(stream_id, i), {_STAGE[0][0]}::double * p.x + ({_STAGE[0][1]}::double) * x1 + {_STAGE[0][2]}::double * x2 - ({_STAGE[0][3]}::double) * y1 - ({_STAGE[0][4]}::double) * y2 as y from walk w join p on p.stream_id = w.stream_id and p.i = w.i + 1))
 select stream_id, cast(floor(greatest(0.0::double, least(1.0::double, ({loudness.OFFSET} + 10 * log10(avg(z1 * z1)) + 20) / 100)) * 1000 + 0.5) as bigint) as share_milli from walk where i >= 0 group by stream_id""")
def q109_weighted_loudness(spark, d):
    """Each stream's values as one block of a signal: loudness with the ear's weighting."""
    signal = F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "value"))), lambda r: r["value"])
    streams = b.frames(spark, d).groupBy("stream_id").agg(signal.alias("x"))
    return streams.select("stream_id", _milli(loudness.loudness_share(F.col("x"), _RATE)).alias("share_milli"))
