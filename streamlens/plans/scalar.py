"""Projections, predicates and scalar functions."""

from pyspark.sql import functions as F

from streamlens.functions import scalars, text, vec
from streamlens.operators.inference import chat_request
from streamlens.plans.registry import EV, FR, TR, content, dot, f1, lng, query, r, unit, words
from streamlens.sources import tables, traces
from streamlens.sources.tables import table


def rd(c, name, digits=6):
    return F.round(c, digits).alias(name)


@query("b1_l2_normalise", f"""
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings),
c AS (SELECT vec_id, v, list_sum(v) / len(v) AS m FROM d),
z AS (SELECT vec_id, v, list_transform(v, lambda x: x - m) AS w FROM c),
u AS (SELECT vec_id, {unit('v')} AS p, {unit('w')} AS q FROM z)
SELECT vec_id, {r("p[1]", "first")}, {r("p[64]", "last_dim")}, {r("q[1]", "first_centred")}, {r("list_sum(list_transform(q, lambda x: x * x))", "norm_centred")} FROM u""")
def b1(spark, path):
    v = F.transform(vec.as_double(F.col("embedding")), lambda x: x * 3)
    p = table(spark, path, "embeddings").select("vec_id", vec.l2_normalise(v).alias("p"), vec.l2_normalise(v, centre=True).alias("q"))
    return p.select("vec_id", rd(F.col("p")[0], "first"), rd(F.col("p")[63], "last_dim"), rd(F.col("q")[0], "first_centred"),
                    rd(vec.dot(F.col("q"), F.col("q")), "norm_centred"))


@query("b2_cosine", f"""
WITH {FR}, n AS (SELECT stream_id, frame_idx, e, lead(e) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS f FROM fr),
d AS (SELECT stream_id, frame_idx, {dot('e', 'f')} AS d FROM n WHERE f IS NOT NULL)
SELECT stream_id, frame_idx, {r("d", "similarity")}, {r("greatest(0.0, least(2.0, 1 - d))", "distance")} FROM d""")
def b2(spark, path):
    fr = tables.frames(spark, path)
    laid = fr.lag(_p="embedding")
    d = laid.df.filter("_p is not null")
    return d.select("stream_id", (F.col("frame_idx") - 1).alias("frame_idx"), rd(vec.dot(F.col("embedding"), F.col("_p")), "similarity"),
                    rd(vec.cosine_distance(F.col("embedding"), F.col("_p")), "distance"))


CELLS = "list_transform(range(0, 8), lambda c: list_transform(e[c * 8 + 1 : c * 8 + 8], lambda x: x * (c + 1)))"


@query("b3_pool_cells", f"""
WITH {FR}, c AS (SELECT stream_id, frame_idx, {CELLS} AS cells FROM fr),
s AS (SELECT stream_id, frame_idx, list_transform(range(1, 9), lambda j: list_sum(list_transform(cells, lambda c: c[j])) / 8.0::DOUBLE) AS m FROM c),
u AS (SELECT stream_id, frame_idx, {unit('m')} AS p FROM s)
SELECT stream_id, frame_idx, {r("p[1]", "first")}, {r("p[8]", "last_dim")} FROM u""")
def b3(spark, path):
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.transform(
        F.slice(vec.as_double(F.col("embedding")), c * 8 + 1, F.lit(8)), lambda x: x * (c + 1)))
    p = tables.frames(spark, path).result().select("stream_id", "frame_idx", vec.pool_cells(cells).alias("p"))
    return p.select("stream_id", "frame_idx", rd(F.col("p")[0], "first"), rd(F.col("p")[7], "last_dim"))


@query("b4_normalise_cells", f"""
WITH {FR}, c AS (SELECT stream_id, frame_idx, unnest(range(0, 8)) AS cell, e FROM fr),
v AS (SELECT stream_id, frame_idx, cell, e[cell * 8 + 1 : cell * 8 + 8] AS v FROM c),
u AS (SELECT stream_id, frame_idx, cell, {unit('v')} AS p FROM v)
SELECT stream_id, frame_idx, {lng("cell", "cell")}, {r("p[1]", "first")}, {r("p[8]", "last_dim")} FROM u""")
def b4(spark, path):
    raw = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice(F.col("embedding"), c * 8 + 1, F.lit(8)))
    rows = tables.frames(spark, path).result().select("stream_id", "frame_idx", F.posexplode(vec.normalise_cells(raw)).alias("cell", "p"))
    return rows.select("stream_id", "frame_idx", F.col("cell").cast("long").alias("cell"), rd(F.col("p")[0], "first"), rd(F.col("p")[7], "last_dim"))


@query("b5_stream_time", f"""WITH {EV} SELECT stream_id, event_id,
{r("coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE t - value END, t)", "t_stream")} FROM ev""")
def b5(spark, path):
    shown = F.when(F.col("event_type") != "view", F.col("t") - F.col("value"))
    return tables.events(spark, path).select("stream_id", "event_id", rd(scalars.stream_time(shown, F.col("t")), "t_stream"))


@query("b6_due_time", f"""WITH {FR} SELECT stream_id, frame_idx, {r("frame_idx / 30.0::DOUBLE", "due_s")},
frame_idx / 30.0::DOUBLE <= 0.75 AS available FROM fr""")
def b6(spark, path):
    i, fps = F.col("frame_idx"), F.lit(30.0)
    return tables.frames(spark, path).result().select("stream_id", "frame_idx", rd(scalars.due_time(i, fps), "due_s"),
                                                      scalars.is_available(i, fps, F.lit(0.75)).alias("available"))


@query("b7_clock_seconds", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%M:%S') END AS s FROM events)
SELECT event_id, s AS stamp, CASE WHEN event_id % 2 = 0
  THEN (CAST(split_part(s, ':', 1) AS INTEGER) * 3600 + CAST(split_part(s, ':', 2) AS INTEGER) * 60 + CAST(split_part(s, ':', 3) AS INTEGER))::DOUBLE
  ELSE (CAST(split_part(s, ':', 1) AS INTEGER) * 60 + CAST(split_part(s, ':', 2) AS INTEGER))::DOUBLE END AS seconds FROM x""")
def b7(spark, path):
    ts = F.col("ts").cast("timestamp")
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "HH:mm:ss")).otherwise(F.date_format(ts, "mm:ss"))
    e = table(spark, path, "events").select("event_id", stamp.alias("stamp"))
    return e.withColumn("seconds", text.clock_seconds(F.col("stamp")))


@query("b8_content_words", f"""WITH w AS (SELECT doc_id, {words('text')} AS w, {content('text')} AS c FROM documents)
SELECT doc_id, {lng("len(w)", "n_words")}, {lng("len(c)", "n_content")}, md5(array_to_string(w, ' ')) AS normalised FROM w""")
def b8(spark, path):
    w = table(spark, path, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(text.keep_content(F.col("w"))).cast("long").alias("n_content"),
                    F.md5(F.concat_ws(" ", "w")).alias("normalised"))


TURNS = "p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)"


def turn_pairs(spark, path):
    """Each conversation turn with the next one, an equi-join on the turn number."""
    c = table(spark, path, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.withColumnRenamed("text", "a").join(nxt, ["conv_id", "turn"])


@query("b9_content_f1", f"""WITH {TURNS}, c AS (SELECT conv_id, turn, {content('a')} AS ca, {content('b')} AS cb FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, {r(f1('ca', 'cb'), "f1")} FROM c""")
def b9(spark, path):
    p = turn_pairs(spark, path).select("conv_id", "turn", text.content_words(F.col("a")).alias("ca"), text.content_words(F.col("b")).alias("cb"))
    return p.select("conv_id", "turn", rd(text.bag_f1(F.col("ca"), F.col("cb")), "f1"))


@query("b9_long_text_f1", f"""
WITH d AS (SELECT doc_id, text, lead(text) OVER (ORDER BY doc_id) AS nxt FROM documents),
wa AS (SELECT doc_id, unnest({content('text')}) AS w FROM d WHERE nxt IS NOT NULL), wb AS (SELECT doc_id, unnest({content('nxt')}) AS w FROM d WHERE nxt IS NOT NULL),
ca AS (SELECT doc_id, w, count(*) AS n FROM wa GROUP BY ALL), cb AS (SELECT doc_id, w, count(*) AS n FROM wb GROUP BY ALL),
x AS (SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, sum(coalesce(ca.n, 0)) AS na, sum(coalesce(cb.n, 0)) AS nb, sum(least(coalesce(ca.n, 0), coalesce(cb.n, 0))) AS both_n
  FROM ca FULL JOIN cb ON ca.doc_id = cb.doc_id AND ca.w = cb.w GROUP BY 1)
SELECT d.doc_id, {r("CASE WHEN na IS NULL THEN 1.0 WHEN na = 0 OR nb = 0 OR both_n = 0 THEN 0.0 ELSE 2.0 * (both_n::DOUBLE / na) * (both_n::DOUBLE / nb) / (both_n::DOUBLE / na + both_n::DOUBLE / nb) END", "content_f1")}
FROM d LEFT JOIN x USING (doc_id) WHERE nxt IS NOT NULL""")
def b9_long(spark, path):
    from streamlens.operators.quality import long_text_f1

    d = table(spark, path, "documents").select("doc_id", "text")
    ids = d.select(F.col("doc_id").alias("a"))
    pairs = ids.join(d.where("text is not null").select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b")), "a")
    return long_text_f1(d, pairs, "doc_id").select(F.col("a").alias("doc_id"), F.round("content_f1", 6).alias("content_f1"))


@query("b10_similarity")
def b10(spark, path):
    return turn_pairs(spark, path).select("conv_id", "turn", rd(text.similarity(F.col("a"), F.col("b")), "similarity"))


@query("b11_degenerate", f"""
WITH w AS (SELECT doc_id, unnest({words('text')}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT doc_id, sum(n) AS total, max(n) AS top FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(total, 0) < 3 OR top::DOUBLE / total > 0.5 AS degenerate FROM documents d LEFT JOIN m USING (doc_id)""")
def b11(spark, path):
    # Words are counted by a shuffle: documents may be long, and a word may fill most of one.
    d = table(spark, path, "documents").select("doc_id", "text")
    counts = d.select("doc_id", F.explode(text.words(F.col("text"))).alias("w")).groupBy("doc_id", "w").count()
    top = counts.groupBy("doc_id").agg(F.sum("count").alias("n"), F.max("count").alias("top"))
    return d.select("doc_id").join(top, "doc_id", "left").select(
        "doc_id", F.coalesce((F.col("n") < 3) | (F.col("top") / F.col("n") > 0.5), F.lit(True)).alias("degenerate"))


@query("b11_degenerate_answers", f"""
WITH w AS (SELECT conv_id, turn, {words('text')} AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) < 3 THEN true ELSE list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x))))::DOUBLE / len(w) > 0.5 END AS degenerate FROM w""")
def b11_answers(spark, path):
    return table(spark, path, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("w")).select(
        "conv_id", "turn", text.is_degenerate(F.col("w")).alias("degenerate"))


SAID = """CASE event_id % 5 WHEN 0 THEN 'The answer is (' || chr(CAST(65 + event_id % 4 AS INTEGER)) || ')' WHEN 1 THEN chr(CAST(65 + event_id % 4 AS INTEGER)) || '. because' WHEN 2 THEN 'no idea'
  WHEN 3 THEN '  (' || chr(CAST(65 + event_id % 7 AS INTEGER)) || ') or B' ELSE '' END"""


def said():
    i = F.col("event_id")
    letter = lambda m: F.chr(65 + i % m)
    return (
        F.when(i % 5 == 0, F.concat(F.lit("The answer is ("), letter(4), F.lit(")")))
        .when(i % 5 == 1, F.concat(letter(4), F.lit(". because"))).when(i % 5 == 2, F.lit("no idea"))
        .when(i % 5 == 3, F.concat(F.lit("  ("), letter(7), F.lit(") or B"))).otherwise(F.lit("")))


LETTER = r"coalesce(nullif(regexp_extract(trim(s), '^[^A-Za-z]*([ABCD])\b', 1), ''), nullif(regexp_extract(trim(s), '\b([ABCD])\b', 1), ''))"


@query("b12_option_letter", f"WITH x AS (SELECT event_id, {SAID} AS s FROM events) SELECT event_id, {LETTER} AS letter FROM x")
def b12(spark, path):
    return table(spark, path, "events").select("event_id", text.option_letter(said()).alias("letter"))


@query("b13_prompt", """SELECT item_id, md5(text || chr(10) || 'A. ' || substr(text, 1, 10) || chr(10) || 'B. ' || substr(text, 11, 10) || chr(10) ||
'Answer with the single letter of the correct option (A, B, C or D) and nothing else.') AS prompt FROM benchmark""")
def b13(spark, path):
    t = F.col("text")
    options = F.array(F.concat(F.lit("A. "), F.substring(t, 1, 10)), F.concat(F.lit("B. "), F.substring(t, 11, 10)))
    return table(spark, path, "benchmark").select("item_id", F.md5(text.choice_prompt(t, options)).alias("prompt"))


REQ_TEXT = "'{{\"type\":\"text\",\"text\":' || to_json(text)::VARCHAR || '}}'"
REQ_IMAGE = "'{{\"type\":\"image_url\",\"image_url\":{{\"url\":\"data:image/jpeg;base64,' || base64(encode(text)) || '\"}}}}'"
REQ_TAIL = "']}}],\"max_tokens\":32,\"temperature\":0.0,\"stream\":true}}'"


@query("b14_request_table", ("SELECT item_id, '{{\"messages\":[{{\"role\":\"user\",\"content\":[' || " + REQ_TEXT + " || ',' || " + REQ_IMAGE + " || " + REQ_TAIL + " AS text_first, "
       "'{{\"messages\":[{{\"role\":\"system\",\"content\":\"You describe scenes.\"}},{{\"role\":\"user\",\"content\":[' || " + REQ_IMAGE + " || ',' || " + REQ_TEXT + " || " + REQ_TAIL + " AS payload_first FROM benchmark").replace("{{", "{").replace("}}", "}"))
def b14(spark, path):
    b = table(spark, path, "benchmark")
    image = F.base64(F.col("text").cast("binary"))
    return b.select("item_id", chat_request(F.col("text"), image).alias("text_first"),
                    chat_request(F.col("text"), image, payload_first=True, system="You describe scenes.").alias("payload_first"))


@query("b15_signal_view", f"WITH {TR} SELECT stream_id, frame_idx, {r('motion', 'novelty')}, {r('motion', 'motion')} FROM tr")
def b15(spark, path):
    v = traces.with_signal(tables.trace(spark, path).result(), "motion")
    return v.select("stream_id", "frame_idx", rd(F.col("novelty"), "novelty"), rd(F.col("motion"), "motion"))


@query("b16_blinded_view", f"WITH {TR} SELECT stream_id, frame_idx, state_id, 0.0::DOUBLE AS motion, 0.0::DOUBLE AS novelty, 0.0::DOUBLE AS scene_change FROM tr")
def b16(spark, path):
    return traces.blinded(tables.trace(spark, path).result()).select("stream_id", "frame_idx", "state_id", "motion", "novelty", "scene_change")


@query("b17_too_dark", f"""WITH {FR} SELECT stream_id, frame_idx, CASE WHEN frame_idx % 5 = 0 THEN NULL
ELSE list_sum(list_transform(e, lambda x: abs(x) * 250)) / 64 < 25 END AS too_dark FROM fr""")
def b17(spark, path):
    thumb = F.when(F.col("frame_idx") % 5 != 0, F.transform(vec.as_double(F.col("embedding")), lambda x: F.abs(x) * 250))
    return tables.frames(spark, path).result().select("stream_id", "frame_idx", scalars.too_dark(thumb).alias("too_dark"))


@query("b18_quantisation_damage", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount * 8 END AS f1, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax * 10 END AS nf, l_returnflag = 'R' AS is_ref, l_quantity * 10 AS p95 FROM lineitem)
SELECT CASE WHEN is_ref OR f1 IS NULL OR nf IS NULL THEN 'n/a' WHEN f1 >= nf THEN 'none measurable' ELSE 'damaged' END AS damage_class, p95 <= 150 AS on_target,
CASE WHEN f1 >= nf THEN 'at_or_above_floor' ELSE 'below_floor' END AS verdict, CAST(count(*) AS BIGINT) AS n,
round(sum(CASE WHEN is_ref OR f1 IS NULL OR nf IS NULL THEN NULL WHEN f1 >= nf THEN 0.0 ELSE nf - f1 END)::DOUBLE, 4) AS damage, round(avg(CASE WHEN is_ref THEN 1.0 ELSE f1 END)::DOUBLE, 6) AS plotted FROM x GROUP BY 1, 2, 3""")
def b18(spark, path):
    l = table(spark, path, "lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.col("l_discount").cast("double") * 8).alias("f1"),
        F.when(F.col("l_linenumber") != 2, F.col("l_tax").cast("double") * 10).alias("nf"),
        (F.col("l_returnflag") == "R").alias("is_ref"), (F.col("l_quantity").cast("double") * 10).alias("p95"))
    d = scalars.quantisation_damage(F.col("f1"), F.col("nf"), F.col("is_ref"))
    l = l.withColumn("d", d)
    cls = F.when(F.col("d").isNull(), F.lit("n/a")).when(F.col("d") == 0, F.lit("none measurable")).otherwise(F.lit("damaged"))
    return l.groupBy(cls.alias("damage_class"), (F.col("p95") <= 150).alias("on_target"),
                     scalars.agreement_verdict(F.col("f1"), F.col("nf")).alias("verdict")).agg(
        F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("damage"),
        F.round(F.avg(F.when(F.col("is_ref"), F.lit(1.0)).otherwise(F.col("f1"))), 6).alias("plotted"))


@query("b19_policy_kind", """
WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN 2.0 ELSE 1.0 END AS p FROM events),
n AS (SELECT event_id, CASE p WHEN 0.0 THEN 'oracle' WHEN 0.25 THEN 'fixed_4hz' WHEN 2.0 THEN 'fixed_2s' ELSE 'fixed_1hz' END AS policy FROM x)
SELECT event_id, policy, CASE WHEN policy LIKE 'fixed%' OR policy = 'oracle' THEN 'fixed_interval' ELSE policy END AS kind FROM n""")
def b19(spark, path):
    i = F.col("event_id") % 4
    period = F.when(i == 0, 0.0).when(i == 1, 0.25).when(i == 2, 2.0).otherwise(1.0)
    return table(spark, path, "events").select("event_id", scalars.period_name(period).alias("policy")).withColumn(
        "kind", scalars.policy_kind(F.col("policy")))


LAGS = "p AS (SELECT *, lag(novelty) OVER w AS pn, t - lag(t) OVER w AS age FROM tr WINDOW w AS (PARTITION BY stream_id ORDER BY t_us, event_id))"


@query("b20_information_gain", f"""WITH {TR}, {LAGS} SELECT stream_id, frame_idx, {r("CASE WHEN age IS NULL THEN 1.0 ELSE greatest(0.0, novelty - pn) * (0.5 + 0.5 * (1 - pow(0.5, age / 86400.0))) END", "gain")} FROM p""")
def b20(spark, path):
    laid = tables.trace(spark, path).lag(pn="novelty", pt="t")
    g = scalars.information_gain(F.col("novelty"), F.col("pn"), F.col("t") - F.col("pt"), 86400.0)
    return laid.df.select("stream_id", "frame_idx", rd(g, "gain"))


@query("b21_logistic", f"""WITH {TR}, {LAGS}, z AS (SELECT stream_id, frame_idx, -1.0 + 3.0 * novelty + 0.5 * scene_change + 1.0 * motion + 0.2 * (coalesce(least(age, 30.0), 30.0) / 10.0) + 2.0 * greatest(0.0, novelty - coalesce(pn, 0.0)) AS z FROM p)
SELECT stream_id, frame_idx, {r("1 / (1 + exp(-greatest(-60.0, least(60.0, z))))", "probability")} FROM z""")
def b21(spark, path):
    laid = tables.trace(spark, path).lag(pn="novelty", pt="t")
    fs = scalars.trigger_features(F.col("novelty"), F.col("scene_change"), F.col("motion"), F.col("t") - F.col("pt"), F.col("pn"))
    return laid.df.select("stream_id", "frame_idx", rd(scalars.logistic(fs, [3.0, 0.5, 1.0, 0.2, 2.0], -1.0), "probability"))


@query("b22_half_life_weight", f"""WITH {TR}, {LAGS} SELECT stream_id, frame_idx, {r("1 - pow(0.5, age / 86400.0)", "weight")}, 1.0::DOUBLE AS no_memory FROM p WHERE age IS NOT NULL""")
def b22(spark, path):
    laid = tables.trace(spark, path).lag(pt="t")
    dt = F.col("t") - F.col("pt")
    return laid.df.filter("pt is not null").select(
        "stream_id", "frame_idx", rd(vec.half_life_weight(dt, 86400.0), "weight"), vec.half_life_weight(dt, 0.0).alias("no_memory"))


LABELS = "CASE p_partkey % 4 WHEN 0 THEN p_brand || ' onnx' WHEN 1 THEN p_brand || '@224 torch fp16' WHEN 2 THEN p_brand || ' (control, no network)' ELSE p_brand || ' onnx@224' END"


def backend_label():
    i, b = F.col("p_partkey") % 4, F.col("p_brand")
    return (
        F.when(i == 0, F.concat(b, F.lit(" onnx"))).when(i == 1, F.concat(b, F.lit("@224 torch fp16")))
        .when(i == 2, F.concat(b, F.lit(" (control, no network)"))).otherwise(F.concat(b, F.lit(" onnx@224"))))


@query("b23_backend_label", f"""WITH x AS (SELECT p_partkey, {LABELS} AS label FROM part)
SELECT p_partkey, CASE WHEN label LIKE '%control%' OR label LIKE '%downsample%' THEN 'control' WHEN label LIKE '%onnx%' THEN 'onnx' ELSE 'torch' END AS backend,
replace(replace(replace(replace(label, ' (control, no network)', ''), '@224', ''), ' torch fp16', ''), ' onnx', '') AS model FROM x""")
def b23(spark, path):
    p = table(spark, path, "part").select("p_partkey", backend_label().alias("label"))
    return p.select("p_partkey", scalars.backend_of(F.col("label")).alias("backend"), scalars.model_of(F.col("label")).alias("model"))


@query("b24_state_lookup", f"""WITH {TR}, s AS (SELECT stream_id, list(state_id ORDER BY frame_idx) AS ids FROM tr GROUP BY 1), g AS (SELECT unnest([-3, 0, 5, 1000]) AS i)
SELECT stream_id, CAST(i AS INTEGER) AS i, ids[least(greatest(i, 0), len(ids) - 1) + 1] AS state_id FROM s, g""")
def b24(spark, path):
    from streamlens.sources import annotations

    d = annotations.state_at(annotation_docs(spark, path), [-3, 0, 5, 1000])
    return d.withColumn("stream_id", F.col("stream_id").cast("long"))


@query("b24_semantic_events", f"""WITH {TR}, m AS (SELECT *, lag(state_id) OVER (PARTITION BY stream_id ORDER BY t_us, event_id) AS ps FROM tr)
SELECT stream_id, round((frame_idx / 30.0)::DOUBLE, 6) AS t_start, 'state_change' AS kind FROM m WHERE ps <> state_id AND motion >= 0.1""")
def b24_events(spark, path):
    from streamlens.sources import annotations

    e = annotations.events(annotation_docs(spark, path), semantic_only=True)
    return e.select(F.col("stream_id").cast("long").alias("stream_id"), rd(F.col("t_start"), "t_start"), "kind")


def annotation_docs(spark, path, part_rows=traces.PART_ROWS):
    """Annotation documents made from the trace, each of a bounded number of rows."""
    laid = tables.trace(spark, path).lag(_ps="state_id")
    event = F.when(F.col("_ps") != F.col("state_id"), F.struct(
        (F.col("frame_idx") / F.lit(30.0)).alias("t_start"), F.lit("state_change").alias("kind"),
        (F.col("motion") >= 0.1).alias("semantic"), F.col("answer").alias("description")))
    packed = laid.df.groupBy("stream_id", F.floor(F.col("frame_idx") / part_rows).alias("_part")).agg(
        F.sort_array(F.collect_list(F.struct("frame_idx", "state_id"))).alias("s"),
        F.sort_array(F.collect_list(event)).alias("events"), F.count("*").cast("int").alias("n_frames"))
    return packed.select(
        F.col("stream_id").cast("string").alias("name"), F.lit("none").alias("path"), F.lit(30.0).alias("fps"), "n_frames",
        (F.col("n_frames") / F.lit(30.0)).alias("duration_s"), "events", F.transform("s", lambda x: x["state_id"]).alias("state_ids"),
        F.lit("test").alias("purpose"), F.lit(1).alias("schema_version"), F.col("s")[0]["frame_idx"].alias("first_frame"))
