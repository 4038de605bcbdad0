"""Queries of requests, answers, prompts and reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstream import config
from turnstream.functions import markers, normalize, prompts
from turnstream.operators import folds, intervals, report
from turnstream.plans import bindings as b
from turnstream.plans.bindings import table, with_
from turnstream.plans.registry import query
from turnstream.sources import audio

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_BEST = """best as (select g.conv_id, g.turn, t.speaker, row_number() over (partition by g.conv_id, g.turn order by case when t.pos is null then null else least(g.e, t.e) - greatest(g.s, t.s) end desc nulls last, t.pos) as k
 from {0} g left join {1} t on t.conv_id = g.conv_id and t.s < g.e and t.e > g.s and t.e > t.s and g.e > g.s)"""


def _joined(separator: str, column: str = "t"):
    ordered = F.array_sort(F.collect_list(F.struct("turn", column)))
    return F.array_join(F.transform(ordered, lambda x: x[column]), separator)


# --- answers of the upstream service


@query(f"""{with_('seg')} select conv_id, turn, (conv_id % 7) * 123 + case when turn % 7 = 6 then 0 else s end as start_cs, (conv_id % 7) * 123 + case when turn % 7 = 5 then 0 else e end as end_cs, md5({_STRIP.format('t')}) as text_md5
 from seg where turn % 4 <> 3 and {_STRIP.format('t')} <> ''""")
def q61_shift_segments(spark, d):
    rows = b.segments(spark, d).select("conv_id", "turn", F.when(F.col("turn") % 7 != 6, F.col("s") / 100).alias("start"), F.when(F.col("turn") % 7 != 5, F.col("e") / 100).alias("end"), F.when(F.col("turn") % 4 == 3, " \n").otherwise(F.col("t")).alias("t"))
    out = markers.shifted_segments(rows, "start", "end", "t", (F.col("conv_id") % 7) * 123 / 100)
    return out.select("conv_id", "turn", report.cents(F.col("start")).alias("start_cs"), report.cents(F.col("end")).alias("end_cs"), F.md5("t").alias("text_md5"))


_SHORT = "regexp_replace(printf('%.2f', ({0}) / 100.0::double), '0$', '')"


@query(f"""{with_('seg')} select conv_id, turn, case when turn % 4 = 1 then role else '' end as language, md5(case turn % 4 when 0 then case when {_STRIP.format('t')} = '' then '' else '<|' || {_SHORT.format('s + (conv_id % 7) * 100')} || '|>' || {_STRIP.format('t')} || '<|' || {_SHORT.format('e + (conv_id % 7) * 100')} || '|>' end
 when 1 then '<|' || {_SHORT.format('s + (conv_id % 7) * 100')} || '|>' || t || '<|' || {_SHORT.format('e + (conv_id % 7) * 100')} || '|>' else '' end) as text_md5 from seg""")
def q62_response_probe(spark, d):
    """Answers with segments, with text and language, with no segments, and with neither."""
    part = F.struct((F.col("s") / 100).alias("start"), (F.col("e") / 100).alias("end"), F.col("t").alias("text"))
    marked = F.concat(F.lit("<|startoftranscript|>"), markers.marked(F.col("s") / 100, F.col("e") / 100, F.col("t")))
    body = F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.array(part).alias("segments")))).when(F.col("turn") % 4 == 1, F.to_json(F.struct(marked.alias("text"), F.col("role").alias("language")))).when(F.col("turn") % 4 == 2, '{"segments": [], "text": "unread"}').otherwise('{"detail": 1}')
    rows = b.segments(spark, d).withColumn("body", body)
    return rows.select("conv_id", "turn", F.coalesce(F.get_json_object("body", "$.language"), F.lit("")).alias("language"), F.md5(prompts.response_text(F.col("body"), F.col("conv_id") % 7)).alias("text_md5"))


# --- speakers of segments, by mode


_GAPS = "gaps as (select conv_id, turn, t, case when turn % 6 = 5 then null else s end as s0, case when turn % 6 >= 4 then null else e end as e0 from seg)"
_ONLINE = "online as (select conv_id, turn, coalesce(s0, 0) as s, coalesce(e0, s0, 0) as e from gaps where conv_id % 3 = 0)"
_OFFLINE = "offline as (select conv_id, turn, coalesce(s0, 0) as s, coalesce(e0, 0) as e from gaps where conv_id % 3 = 1)"
_CHUNKS = "chunks as (select conv_id, row_number() over (partition by conv_id order by s, pos) as pos, s, e, cast(pos as varchar) as speaker from turns where e > s)"


@query(f"""{with_('seg', 'turns')}, {_GAPS}, {_ONLINE}, {_OFFLINE}, {_CHUNKS}, {_BEST.format('online', 'chunks')}, {_BEST.format('offline', 'turns').replace('best as', 'far as')}
 select conv_id, turn, coalesce(case when cast(speaker as int) % 4 <> 3 then (cast(speaker as int) * 7) % 3 end, 0) as speaker from best where k = 1
 union all select conv_id, turn, coalesce(try_cast(replace(speaker, 'SPEAKER_', '') as int), 0) from far where k = 1 union all select conv_id, turn, -1 from gaps where conv_id % 3 = 2""")
def q63_speaker_merge(spark, d):
    """A third of the conversations each online, offline and in no mode; some segments lack times."""
    at = F.col("turn") % 6
    gaps = b.segments(spark, d).select("conv_id", "turn", F.when(at != 5, F.col("s")).alias("s"), F.when(at < 4, F.col("e")).alias("e"))
    turns = b.turns(spark, d)
    chunks = turns.filter("e > s").select("conv_id", F.col("pos").alias("chunk_idx"), "s", "e")
    assigned = chunks.filter("chunk_idx % 4 <> 3").select("conv_id", "chunk_idx", ((F.col("chunk_idx") * 7) % 3).alias("speaker"))
    of = lambda k: gaps.filter(F.col("conv_id") % 3 == k)
    online = intervals.merge_speakers(of(0), assigned, "online", "conv_id", "turn", chunks)
    offline = intervals.merge_speakers(of(1), turns, "offline", "conv_id", "turn")
    neither = intervals.merge_speakers(of(2), None, "none", "conv_id", "turn").withColumn("speaker", F.lit(-1))
    return online.unionByName(offline).unionByName(neither).select("conv_id", "turn", F.col("speaker").cast("int").alias("speaker"))


@query(f"""{with_('seg', 'turns')}, parts as (select conv_id, turn, role, {_STRIP.format('t')} as t, s, e from seg where turn % 9 <> 8), {_BEST.format('parts', 'turns')},
 one as (select conv_id, turn, t, e, coalesce(try_cast(replace(speaker, 'SPEAKER_', '') as int), 0) as speaker from parts join best using (conv_id, turn) where k = 1)
 select conv_id, coalesce(any_value(language), 'unknown') as language, max_by(e, turn) as duration_cs, count(*) as n_segments, md5(string_agg(t, ' ' order by turn)) as text_md5, string_agg(cast(speaker as varchar), ',' order by turn) as speakers
 from one left join (select conv_id, min_by(role, turn) filter (where role <> 'user') as language from seg group by conv_id) using (conv_id) group by conv_id""")
def q64_process_transcription(spark, d):
    """The whole request: chunk texts shifted and joined, parsed, given speakers, and shaped into one answer."""
    return transcribed(b.segments(spark, d).filter("turn % 9 <> 8"), b.segments(spark, d), b.turns(spark, d))


def transcribed(chunks: DataFrame, all_chunks: DataFrame, turns: DataFrame) -> DataFrame:
    """One answer a conversation from its chunks kept after the silence filter, the languages heard, and the turns."""
    own = F.concat(F.lit("<|0.00|>"), F.col("t"), F.format_string("<|%.2f|>", (F.col("e") - F.col("s")) / 100))
    text = chunks.select("conv_id", "turn", markers.shifted(own, F.col("s")).alias("t")).groupBy("conv_id").agg(_joined("").alias("text"))
    centi = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    parsed = markers.parse(text, "text", ["conv_id"]).select("conv_id", F.col("id").alias("turn"), centi("start").alias("s"), centi("end").alias("e"), F.col("text").alias("t"))
    spoken = intervals.merge_speakers(parsed, turns, "offline", "conv_id", "turn")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "speaker"))), lambda x: x["speaker"].cast("string")), ",")
    answer = spoken.groupBy("conv_id").agg(F.max_by("e", "turn").alias("duration_cs"), F.count("*").alias("n_segments"), _joined(" ").alias("joined"), said.alias("speakers"))
    language = report.first_of(all_chunks.withColumnRenamed("role", "language"), "conv_id", "turn", "language", F.col("language") != "user")
    out = text.join(answer, "conv_id").join(language, "conv_id", "left")
    # an empty text falls back to what is left without markers
    final = F.when(F.col("joined") == "", markers.without_markers(F.col("text"))).otherwise(F.col("joined"))
    return out.select("conv_id", F.coalesce("language", F.lit("unknown")).alias("language"), "duration_cs", "n_segments", F.md5(final).alias("text_md5"), "speakers")


@query(f"""{with_('seg')}, x as (select conv_id, string_agg({_STRIP.format('t')}, ' ' order by turn) as t, max_by(e, turn) as e, count(*) as n from seg group by conv_id)
 select conv_id, md5(case conv_id % 3 when 0 then t when 1 then cast(json_object('text', t) as varchar) else cast(json_object('language', 'unknown', 'duration_cs', e, 'text', t, 'n_segments', n) as varchar) end) as body_md5 from x""")
def q65_answer_shapes(spark, d):
    """Text, a JSON object with the text, and the verbose one, a third of the conversations each."""
    one = b.segments(spark, d).withColumn("t", markers.stripped(F.col("t"))).groupBy("conv_id").agg(_joined(" ").alias("text"), F.max_by("e", "turn").alias("duration_cs"), F.count("*").alias("n_segments"))
    verbose = F.to_json(F.struct(F.lit("unknown").alias("language"), "duration_cs", "text", "n_segments"))
    return one.select("conv_id", F.md5(F.when(F.col("conv_id") % 3 == 0, F.col("text")).when(F.col("conv_id") % 3 == 1, F.to_json(F.struct("text"))).otherwise(verbose)).alias("body_md5"))


# --- live messages


@query("""with m as (select user_id, event_id, 100 + event_id % 900 as n, cast(sum(100 + event_id % 900) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as upto from events)
 select user_id, event_id, upto // 512 - (upto - n) // 512 as n_frames, upto % 512 as carried from m""")
def q66_reframe_messages(spark, d):
    """Messages of any number of samples cut into frames of 512; what is left waits for the next message."""
    n = F.lit(100) + F.col("event_id") % 900
    upto = F.sum(n).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "events").withColumn("n", n).withColumn("upto", upto).select("user_id", "event_id", (F.floor(F.col("upto") / 512) - F.floor((F.col("upto") - F.col("n")) / 512)).alias("n_frames"), (F.col("upto") % 512).alias("carried"))


@query("""select user_id, row_number() over (partition by user_id order by done, event_id) as place, event_id, case when failed then 'error' else 'transcription' end as type from
 (select user_id, event_id, epoch_us(ts) + (event_id * 7919) % 1000000000 as done, event_id % 11 = 3 as failed from events)""")
def q67_completion_order(spark, d):
    """Results leave in the order in which they are done; one that failed is an error message and stops no other."""
    done = F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") * 7919) % 1_000_000_000
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("done", "event_id")).cast("long")
    return table(spark, d, "events").withColumn("done", done).select("user_id", place.alias("place"), "event_id", F.when(F.col("event_id") % 11 == 3, "error").otherwise("transcription").alias("type"))


# --- requests to models


@query("select doc_id, nullif(nullif(case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then 'null' else lang end, 'null'), '') as language from documents")
def q68_language_field(spark, d):
    stated = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, "null").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", prompts.language_field(stated).alias("language"))


_NAMES = [("1-URGENT", "urgent"), ("2-HIGH", "urgent"), ("3-MEDIUM", "normal")]


@query(f"""with names(alias, name) as (values {', '.join(f"('{a}', '{n}')" for a, n in _NAMES)}) select coalesce(name, o_orderpriority) as model, count(*) as requests, cast(sum(cast(floor(o_totalprice * 100 + 0.5) as bigint)) as bigint) as tokens from orders left join names on alias = o_orderpriority group by all""")
def q69_model_alias(spark, d):
    names = spark.createDataFrame(_NAMES, "alias string, name string")
    orders = prompts.alias(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "model"), names, "model")
    return orders.groupBy("model").agg(F.count("*").alias("requests"), F.sum(report.cents(F.col("o_totalprice"))).alias("tokens"))


@query("select s_nationkey, min_by(s_name, s_suppkey) filter (where s_acctbal > 9000) as host, case when count(*) filter (where s_acctbal > 9000) = 0 then 429 else 200 end as status from supplier group by s_nationkey")
def q70_host_or_busy(spark, d):
    rows = table(spark, d, "supplier").withColumnRenamed("s_name", "host")
    found = report.first_of(rows, "s_nationkey", "s_suppkey", "host", F.col("s_acctbal") > 9000)
    return found.withColumn("status", F.when(F.col("host").isNull(), 429).otherwise(200))


_WORDS = "list_filter(string_split_regex(lower(coalesce(t, '')), '\\s+'), lambda w: w <> '')"
_SPECIAL = ["system", "und", "with"]


@query(f"""{with_('seg')}, m as (select conv_id, bool_or(list_has_any({_WORDS}, {_SPECIAL})) as blocked, count(*) as n, string_agg(t, '|' order by turn) as all_text from seg group by conv_id)
 select conv_id, cast(blocked as int) as blocked, case when blocked then 1 else n end as n_messages, md5(case when blocked then '{prompts.REFUSAL}' else all_text end) as content_md5 from m""")
def q71_injection_guard(spark, d):
    words = normalize.words_of(F.lower(F.col("t")))
    rows = b.segments(spark, d).select("conv_id", F.struct("turn", "role", F.col("t").alias("content"), words.alias("words")).alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("m.turn", "m.role", "m.content", "m.words"))).alias("all"))
    messages = F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    out = rows.select("conv_id", messages.alias("asked"), F.flatten(F.transform("all", lambda m: m["words"])).alias("tokens")).withColumn("messages", prompts.guarded(F.col("asked"), F.col("tokens"), _SPECIAL))
    return out.select("conv_id", F.arrays_overlap("tokens", F.array(*map(F.lit, _SPECIAL))).cast("int").alias("blocked"), F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|")).alias("content_md5"))


_VOICE = ["zero", "one", "two", "three", "four"]


@query("""with v as (select ['zero', 'one', 'two', 'three', 'four'] as w) select doc_id, case doc_id % 4 when 1 then 2 when 3 then 2 else 1 end as n_texts, md5(case doc_id % 4 when 0 then source when 1 then source || '|' || coalesce(lang, '')
 when 2 then w[doc_id % 5 + 1] || ' ' || w[n_chars % 5 + 1] else w[doc_id % 5 + 1] || '|' || w[n_chars % 5 + 1] || ' ' || w[1] end) as texts_md5 from documents, v""")
def q72_embedding_input(spark, d):
    """An input is a text, texts, ids, or lists of ids; ids stand for words."""
    q = lambda c: F.to_json(F.struct(c.alias("x")))
    text = F.regexp_replace(q(F.col("source")), r'^\{"x":|\}$', "")
    texts = F.to_json(F.array("source", F.coalesce("lang", F.lit(""))))
    i, j = F.col("doc_id") % 5, F.col("n_chars") % 5
    value = F.when(F.col("doc_id") % 4 == 0, text).when(F.col("doc_id") % 4 == 1, texts).when(F.col("doc_id") % 4 == 2, F.to_json(F.array(i, j))).otherwise(F.to_json(F.array(F.array(i), F.array(j, F.lit(0)))))
    strings = prompts.input_strings(value, F.array(*map(F.lit, _VOICE)))
    return table(spark, d, "documents").select("doc_id", strings.alias("texts")).select("doc_id", F.size("texts").alias("n_texts"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


@query(f"""{with_('seg')}, dictionary as (select chr(cast(97 + i as int)) as token, i + 2 as token_id from range(26) r(i)), tokens as (select conv_id, turn, unnest(string_split(lower(t), '')) as token from seg)
 select conv_id, turn, count(*) as n_tokens, cast(sum(token_id) as bigint) as id_sum from tokens join dictionary using (token) group by conv_id, turn""")
def q73_token_dictionary(spark, d):
    """Letters of each turn joined with a dictionary table; stars and whatever it lacks are dropped."""
    dictionary = spark.range(26).select(F.char((F.col("id") + 97).cast("long")).alias("token"), (F.col("id") + 2).alias("token_id"))
    tokens = normalize.starred(F.filter(F.split(F.lower("t"), ""), lambda c: c != ""), "edges")
    rows = b.segments(spark, d).select("conv_id", "turn", F.explode(tokens).alias("token")).filter("token <> '<star>'")
    counted = rows.groupBy("conv_id", "turn", "token").count()
    return counted.join(dictionary, "token").groupBy("conv_id", "turn").agg(F.sum("count").alias("n_tokens"), F.sum(F.col("count") * F.col("token_id")).alias("id_sum"))


_TTL = 3 * 86_400_000_000


@query(f"""with recursive a as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) - 1 as i, cast(floor(value) as bigint) as n from events),
 walk as (select user_id, event_id, i, -1::bigint as used, false as refused, -1 + n as value, us as written from a where i = 0
 union all select user_id, event_id, i, used, used > 120, case when used > 120 then used else used + n end, case when used > 120 then written else us end
 from (select a.*, w.written, case when a.us - w.written >= {_TTL} then -1::bigint else w.value end as used from walk w join a on a.user_id = w.user_id and a.i = w.i + 1))
 select user_id, event_id, used, cast(refused as int) as refused from walk""")
def q74_quota_with_expiry(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.floor("value").alias("tokens"))
    out = folds.fold(rows, ["user_id"], ["at", "item"], ["tokens"], lambda: folds.Quota(120, _TTL), "event_id long, used long, refused boolean")
    return out.withColumn("refused", F.col("refused").cast("int"))


@query(f"""{with_('seg')}, m as (select conv_id, max_by(role, -turn) as role, max_by(t, -turn) as t, count(*) as n from seg group by conv_id), p as (select *, case when conv_id % 3 = 0 then '' else '{prompts.TOOLS_BEFORE}' || '{{{{' || chr(10) || '    "name": "' || role || '"' || chr(10) || '}}}}' || '{prompts.TOOLS_BEHIND}' end as fs from m)
 select conv_id, n - case when role = 'system' then 1 else 0 end + case when {_STRIP.format("case when role = 'system' then t || chr(10) || chr(10) || fs else fs end")} = '' then 0 else 1 end as n_messages,
 md5(case when {_STRIP.format("case when role = 'system' then t || chr(10) || chr(10) || fs else fs end")} = '' then case when role = 'system' then null else t end when role = 'system' then t || chr(10) || chr(10) || fs else fs end) as first_md5 from p""".replace("{{", "{").replace("}}", "}"))
def q75_prompt_assembly(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("t").alias("content"))))
    rows = b.segments(spark, d).groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    tool = F.to_json(F.struct(F.get("messages", F.lit(0))["role"].alias("name")))
    rows = rows.withColumn("tool", prompts.pretty_json(tool))
    tools = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("tool"))
    out = rows.select("conv_id", prompts.with_system(F.col("messages"), prompts.tools_prompt(tools)).alias("m"))
    return out.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.md5(F.get("m", F.lit(0))["content"]).alias("first_md5"))


@query(f"{with_('seg')} select conv_id, turn, md5(case when turn % 2 = 0 then '<|' || (conv_id % 4) || '|><|0.00|>' || t || '<|1.00|>' else t || '<|' || (conv_id % 4) || '|>' end) as text_md5 from seg where not contains(t, '<|')")
def q76_speaker_tag(spark, d):
    rows = b.segments(spark, d).filter(~F.col("t").contains("<|"))
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<|0.00|>"), "t", F.lit("<|1.00|>"))).otherwise(F.col("t"))
    return rows.select("conv_id", "turn", F.md5(prompts.with_speaker_tag(text, (F.col("conv_id") % 4).cast("string"))).alias("text_md5"))


@query(f"""{with_('seg')}, x as (select conv_id, turn, len(string_split_regex(trim(t), '\\s+')) as n, regexp_replace(trim(regexp_replace(t, ' +', ' ', 'g')), '\\s+', ' ', 'g') as t from seg)
 select conv_id, turn, md5(array_to_string(list_transform(list_filter(string_split(t || ' see 3 to 5 items', ' '), lambda w: w <> ''), lambda w: case when w = 'ß' then 'SS' when length(w) = 1 then upper(w) else w end), ' ')) as text_md5 from x""")
def q77_spoken_text(spark, d):
    rows = b.segments(spark, d)
    return rows.select("conv_id", "turn", F.md5(prompts.spoken(F.concat("t", F.lit("\nsee 3-5 items")))).alias("text_md5"))


# --- reports


_CENTS = "cast(floor(o_totalprice * 100 + 0.5) as bigint)"
_AUDIO = 14494.0


def _statistics_sql(key: str, source: str, value: str) -> str:
    at = lambda q, least: f"case when count(*) >= {least} then (list_sort(list({value})))[greatest(1, cast(floor({q}::double * count(*)) as bigint))] else max({value}) end"
    return f"select {key}, count(*) as n, min({value}) as least, max({value}) as most, cast(sum({value}) as bigint) as total, (list_sort(list({value})))[(count(*) + 1) // 2] as p50, {at(0.90, 10)} as p90, {at(0.95, 20)} as p95, {at(0.99, 100)} as p99 from {source} group by {key}"


def _milli(x: str) -> str:
    return f"cast(floor(({x}) * 1000 + 0.5) as bigint)"


_RATES = ", ".join(
    [f"{_milli(f'{c}::double / {_AUDIO}::double')} as rtf_{c}" for c in ("least", "most", "p90", "p95", "p99")]
    + [f"{_milli('n::double / n_all')} as success_milli", f"{_milli('total::double / n')} as avg_milli", f"{_milli(f'total::double / n / {_AUDIO}::double')} as rtf_avg", f"{_milli('n::double / most::double')} as per_wall", f"{_milli(f'n::double * {_AUDIO}::double / most::double')} as audio_per_wall"]
)


@query(f"""with s as ({_statistics_sql('o_orderpriority', f"(select o_orderpriority, {_CENTS} as latency from orders where o_orderstatus <> 'P')", 'latency')}), a as (select o_orderpriority, count(*) as n_all from orders group by o_orderpriority)
 select o_orderpriority, n, {_RATES} from s join a using (o_orderpriority)""")
def q78_latency_rates(spark, d):
    orders = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", report.cents(F.col("o_totalprice")).alias("latency"))
    statistics = report.order_statistics(orders.filter("o_orderstatus <> 'P'"), ["o_orderpriority"], "latency")
    rows = statistics.join(orders.groupBy("o_orderpriority").agg(F.count("*").alias("n_all")), "o_orderpriority")
    rates = report.with_rates(rows, F.col("n_all").cast("double"), F.lit(_AUDIO))
    return rates.select("o_orderpriority", "n", *[c for c in rates.columns if c.startswith("rtf_")], "success_milli", "avg_milli", "per_wall", "audio_per_wall")


@query("""with c as (select user_id, count(*) filter (where value > 30) as segments, count(*) filter (where value <= 30) as silent, cast(floor(min(value) filter (where value > 30) * 100 + 0.5) as bigint) as ttft from events group by user_id)
 select count(*) as clients, cast(sum(segments) as bigint) as segments, cast(sum(silent) as bigint) as silent, cast(floor(cast(sum(segments) as double) / count(*) * 10 + 0.5) as bigint) as per_client_tenths, min(ttft) as ttft_least, max(ttft) as ttft_most,
 case when count(ttft) >= 10 then (list_sort(list(ttft) filter (where ttft is not null)))[greatest(1, cast(floor(0.9::double * count(ttft)) as bigint))] else max(ttft) end as ttft_p90 from c""")
def q79_client_report(spark, d):
    """Segments and silence by client; clients without a first transcription do not count in its times."""
    speech = F.col("value") > 30
    clients = table(spark, d, "events").groupBy("user_id").agg(F.count_if(speech).alias("segments"), F.count_if(~speech).alias("silent"), report.cents(F.min(F.when(speech, F.col("value")))).alias("ttft"))
    ttft = report.order_statistics(clients.filter("ttft is not null").withColumn("all", F.lit(1)), ["all"], "ttft")
    counts = clients.agg(F.count("*").alias("clients"), F.sum("segments").alias("segments"), F.sum("silent").alias("silent")).withColumn("all", F.lit(1))
    tenths = F.floor(F.col("segments").cast("double") / F.col("clients") * 10 + 0.5).cast("long")
    return counts.join(ttft, "all").select("clients", "segments", "silent", tenths.alias("per_client_tenths"), F.col("least").alias("ttft_least"), F.col("most").alias("ttft_most"), F.col("p90").alias("ttft_p90"))


@query("""select o_orderstatus, count(*) as n, min(x) as least, max(x) as most, cast(floor(cast(sum(x) as double) / count(*) * 1000 + 0.5) as bigint) as avg_milli from (select o_orderstatus, cast(floor(o_totalprice * 100 + 0.5) as bigint) as x from orders) group by o_orderstatus""")
def q80_elapsed_by_status(spark, d):
    return report.elapsed_by(table(spark, d, "orders").select("o_orderstatus", report.cents(F.col("o_totalprice")).alias("x")), "o_orderstatus", "x")


@query("""with m as (select l_linestatus as method, avg(cast(floor(l_quantity) as bigint)) as a, min(cast(floor(l_quantity) as bigint)) as least from lineitem group by l_linestatus)
 select method, cast(floor(a * 1000 + 0.5) as bigint) as avg_milli, least, cast(floor(a / 14494.0::double * 1000000 + 0.5) as bigint) as rtf_micro, cast(floor((select a from m where method = 'F') / a * 1000 + 0.5) as bigint) as speed_up_milli from m""")
def q81_method_benchmark(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("method"), F.floor("l_quantity").alias("x"))
    return report.speed_up(rows, "method", "F", "x", F.lit(_AUDIO))


@query("""with w as (select lang, n_chars, len(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) as n from documents), f as (select avg(n_chars)::double as audio from documents)
 select lang, count(*) as requests, cast(sum(n) as bigint) as n_words, max(n_chars) as wall, cast(floor(max(n_chars)::double / any_value(audio) * 1000 + 0.5) as bigint) as rtf_most, cast(floor(sum(n_chars)::double / max(n_chars) * 1000 + 0.5) as bigint) as aligned_per_wall from w, f group by lang""")
def q82_alignment_report(spark, d):
    """Real-time factors against the mean length of all files."""
    n = F.size(normalize.words_of(F.lower(F.coalesce("text", F.lit("")))))
    rows = table(spark, d, "documents").select("lang", F.col("n_chars").cast("long").alias("n_chars"), n.alias("n"))
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("requests"), F.sum("n").alias("n_words"), F.max("n_chars").alias("wall"), F.sum("n_chars").alias("total"))
    every = Window.partitionBy(F.lit(0))  # of one row a language
    audio = F.sum("total").over(every).cast("double") / F.sum("requests").over(every)
    return by_lang.select("lang", "requests", "n_words", "wall", report.milli(F.col("wall").cast("double") / audio).alias("rtf_most"), report.milli(F.col("total").cast("double") / F.col("wall")).alias("aligned_per_wall"))


# --- checks of requests, and lines of events


@query("""select vec_id, cast(vec_id % 12 / 10.0::double > 0 and vec_id % 12 / 10.0::double < 1 and vec_id % 103 > 1 and vec_id % 103 < 100 and vec_id % 5 >= 1 and vec_id % 7 >= 1 and vec_id % 11 / 10.0::double > 0 and vec_id % 11 / 10.0::double < 1 as int) as valid from embeddings""")
def q99_valid_parameters(spark, d):
    """Similarity, speakers, silence, trigger and rejection ratio of a request within their ranges."""
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", config.valid_parameters(i % 12 / 10, i % 103, i % 5, i % 7, i % 11 / 10).cast("int").alias("valid"))


@query("select event_id, event_type as type, cast(floor(value * 100 + 0.5) as bigint) as cents from events where event_id % 4 <> 0")
def q100_event_lines(spark, d):
    """Lines of an event stream: data lines are read back, the closing line, comments and others are not."""
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("value")))
    line = F.when(F.col("event_id") % 8 == 0, "data: [DONE]").when(F.col("event_id") % 4 == 0, F.concat(F.lit(": "), body)).otherwise(F.concat(F.lit("data: "), body))
    lines = audio.event_lines(table(spark, d, "events").select(line.alias("line")), "line", "id long, type string, value double")
    return lines.select(F.col("event.id").alias("event_id"), F.col("event.type").alias("type"), report.cents(F.col("event.value")).alias("cents"))
