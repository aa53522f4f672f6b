"""Queries over samples and agents: prompts, answers out of generated text, states, batches; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesselkg.functions import prompts, templates
from tesselkg.operators import sequence, vector
from tesselkg.plans import runs
from tesselkg.plans.knowledge import _with
from tesselkg.plans.retrieval import BAG
from tesselkg.plans.runs import ACT, HIST, OPTS, REW, SCORED
from tesselkg.session import table

BATCH, SAMPLE, LAST_TURNS, RECENT, LAST_REWARDS = 32, 50, 2, 100, 10


def _hash(text: Column) -> Column:
    """A whole number from 0 to 2^32 - 1, the same on every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _generated(spark, d) -> DataFrame:
    """(result_id, t): a text taken as generated for each run: the history alone, with the stored letter in either of two wordings, or nothing."""
    h = F.coalesce(prompts.history_text(F.col("user_query")), F.lit(""))
    said = F.coalesce("predicted_option", F.lit("?"))
    kind = F.col("result_id") % 4
    text = F.when(kind == 0, h).when(kind == 1, F.concat(F.lit("I would pick ("), said, F.lit(") after "), h)).when(kind == 2, F.concat(h, F.lit(" Answer "), said)).otherwise("")
    return runs.runs(spark, d).select("result_id", text.alias("t"))


GEN = f"""gen AS (SELECT result_id, CASE result_id % 4 WHEN 0 THEN h WHEN 1 THEN 'I would pick (' || said || ') after ' || h WHEN 2 THEN h || ' Answer ' || said ELSE '' END AS t
FROM (SELECT result_id, coalesce({HIST}, '') AS h, coalesce(predicted_option, '?') AS said FROM pipeline_result))"""


def answer_of_run(spark, d):
    """The letter of each run's text: an explicit form, else the most mentioned title, else a lone letter, else the default."""
    text = _generated(spark, d)
    counted = runs.options(spark, d).join(text, "result_id").withColumn("n", prompts.count_of(F.upper("t"), F.upper("title"))).where("n > 0")
    named = counted.groupBy("result_id").agg(F.max_by("letter", F.struct("n", -F.col("pos"))).alias("named"))
    t = F.col("t")
    letter = F.when(t == "", prompts.DEFAULT_ANSWER).otherwise(F.coalesce(prompts.explicit_answer(t), "named", prompts.lone_letter(t)))
    return text.join(named, "result_id", "left").select("result_id", letter.alias("letter"))


def option_of_generation(spark, d):
    """The option a generated text chooses: its last letter, one of four wordings, the most weight of mentions, else the first option."""
    options = runs.options(spark, d)
    text = _generated(spark, d).withColumn("t", F.regexp_replace("t", r"^\s+|\s+$", ""))
    up = F.upper("t")
    weight = lambda o: 2 * sum(prompts.count_of(up, F.concat(F.lit(a), "letter", F.lit(b))) for a, b in ((" ", " "), ("(", ")"), ("", ":"))) + prompts.count_of(up, F.substring(F.upper("title"), 1, 20))
    rows = options.join(text, "result_id").withColumn("w", weight(options))
    per = rows.groupBy("result_id").agg(
        F.collect_set("letter").alias("letters"), F.max_by("letter", F.struct("w", -F.col("pos"))).alias("best"), F.max("w").alias("w"), F.min_by("letter", "pos").alias("first"), F.first("t").alias("t")
    )
    last = F.upper(F.substring("t", -1, 1))
    found = F.when(F.array_contains("letters", last), last)
    for form in prompts.GENERATED_FORMS:
        letter = F.upper(F.regexp_extract("t", form, 1))
        found = F.coalesce(found, F.when(F.array_contains("letters", letter), letter))
    return per.select("result_id", F.coalesce(found, F.when(F.col("w") > 0, F.col("best")), "first").alias("letter"))


def sample_preprocess(spark, d):
    """The task prompt of each stored sample in its domain, with what it asks, the number of its options and the correct letter."""
    q = F.col("user_query")
    music = F.contains(q, F.lit("Listening history:"))
    rows = runs.runs(spark, d).where("user_query is not null").select("result_id", prompts.history_text(q).alias("h"), prompts.options_text(q).alias("o"), music.alias("music"))
    domain = lambda name: templates.filled(templates.TASK, instruction=templates.DOMAINS[name][0], label=templates.DOMAINS[name][1], history=F.col("h"), options=F.col("o"), item=templates.DOMAINS[name][2])
    truth = runs.scored(spark, d).where("is_truth").select("result_id", F.col("letter").alias("correct_answer"), F.col("n").alias("n_options"))
    return rows.join(truth, "result_id", "left").select("result_id", F.when(F.col("music"), domain("music")).otherwise(domain("movie")).alias("task_prompt"), F.col("h").alias("retrieval_query"), F.coalesce("n_options", F.lit(0)).cast("long").alias("n_options"), "correct_answer")


def recent_turns(spark, d):
    """The last two turns of each user, oldest first; a turn without a query or an answer is left out after the cut."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("result_id")))
    rows = runs.runs(spark, d).where("user_id is not null").select("user_id", "created_at", "result_id", "user_query", "predicted_option").withColumn("back", order).where(F.col("back") <= LAST_TURNS)
    turn = F.when((F.coalesce("user_query", F.lit("")) != "") & (F.coalesce("predicted_option", F.lit("")) != ""), F.struct((-F.col("back")).alias("o"), F.concat(F.lit("User: "), "user_query", F.lit("\nBot: "), "predicted_option").alias("t")))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]), "\n").alias("turns"))


def alignment_prompts(spark, d):
    """The prompt that turns each run's document into knowledge, by the kind of its expert; the history stands for the document."""
    q = F.coalesce("user_query", F.lit(""))
    rows = runs.runs(spark, d).select("result_id", q.alias("q"), F.coalesce(prompts.history_text(F.col("user_query")), F.lit("")).alias("doc"), F.coalesce("selected_retriever_id", F.lit(1)).alias("e"))
    make = lambda kind: templates.filled(templates.ALIGNMENT[kind], query=F.col("q"), preferences=templates.GENERAL_USER, document=F.col("doc"), kind="movie")
    text = F.when(F.col("e") == 2, make("triple")).when(F.col("e") == 3, make("subgraph")).when(F.col("e") == 4, make("connected_graph")).otherwise(make("direct"))
    return rows.select("result_id", text.alias("prompt"))


def _knowing(spark, d) -> DataFrame:
    q = F.coalesce("user_query", F.lit(""))
    return runs.runs(spark, d).select("result_id", "user_id", q.alias("q"), F.coalesce(prompts.history_text(F.col("user_query")), F.lit("")).alias("k"))


def _preview(knowledge: Column) -> Column:
    return F.when(F.length(knowledge) > templates.MOST_PREVIEW, F.concat(F.substring(knowledge, 1, templates.MOST_PREVIEW), F.lit("..."))).otherwise(knowledge)


def template_explanation(spark, d):
    """The explanation made without a model."""
    return _knowing(spark, d).select("result_id", templates.filled(templates.SAID, query=F.substring("q", 1, templates.MOST_QUERY), knowledge=_preview(F.col("k")), preferences="your preferences").alias("text"))


def explanation_prompts(spark, d):
    text = templates.filled(templates.EXPLANATION, query=F.col("q"), user_type=templates.GENERAL_TYPE, preferences=templates.GENERAL_PREFERENCES, knowledge=F.substring("k", 1, templates.MOST_EXPLAINED))
    return _knowing(spark, d).select("result_id", text.alias("prompt"))


def recommendation_prompts(spark, d):
    """The prompt of the recommendation, with the user's last turns where there are any."""
    rows = _knowing(spark, d).join(template_explanation(spark, d), "result_id").join(recent_turns(spark, d), "user_id", "left")
    turns = F.when(F.coalesce("turns", F.lit("")) != "", templates.filled(templates.TURNS, turns=F.col("turns"))).otherwise("")
    text = templates.filled(
        templates.RECOMMENDATION, query=F.col("q"), user_type=templates.GENERAL_TYPE, preferences=templates.GENERAL_PREFERENCES, turns=turns,
        knowledge=F.substring("k", 1, templates.MOST_RECOMMENDED), explanation=F.col("text"), kind="movie", item="movie", title="Movie",
    )
    return rows.select("result_id", text.alias("prompt"))


def mention_words(spark, d):
    """The first three long words of each document's title and text."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(prompts.mentions(F.concat_ws(" ", "title", "text")), ",").alias("mentions"))


def text_option_distribution(spark, d):
    """Softmax of the similarity between each history and the options' titles under the hashed encoder; even where the history has no words."""
    h = runs.runs(spark, d).select("result_id", vector.hashed_words(prompts.history_text(F.col("user_query"))).alias("h"))
    rows = runs.options(spark, d).select("result_id", "letter", vector.hashed_words(F.col("title")).alias("v")).join(h, "result_id")
    sim = F.coalesce(F.aggregate(F.zip_with("h", "v", lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, x: s + x), F.lit(0.0))
    per = Window.partitionBy("result_id")  # at most twenty letters
    rows = rows.select("result_id", "letter", sim.alias("s")).withColumn("e", F.exp(F.col("s") - F.max("s").over(per)))
    return rows.select("result_id", "letter", F.round(F.col("e") / F.sum("e").over(per), 6).alias("p"))


def semantic_gain(spark, d):
    """The gain where no distributions are stored: of the run's text over its baseline run's, both compared with the run's options under the hashed encoder.

    Texts are joined, not vectors, and never broadcast: the planner takes a
    text for 20 bytes and a vector for 8. With cosines from 0 to 1 and at most
    twenty letters, no share is small enough to be clipped as in ``kl_gain``.
    """
    history = prompts.history_text(F.col("user_query"))
    base = runs._baselines(spark, d, history).withColumnRenamed("base_id", "g")
    own = runs.runs(spark, d).where(F.coalesce("selected_retriever_id", F.lit(1)) != 1).select("user_id", "result_id", history.alias("h"), prompts.options_list(prompts.options_text(F.col("user_query"))).alias("o"))
    titles = F.transform(F.array_distinct(F.col("o.letter")), lambda x: F.element_at(F.filter("o", lambda y: y["letter"] == x), -1)["title"])  # of a repeated letter the last title holds
    rows = own.where(F.size("o") > 0).select("user_id", "result_id", "h", titles.alias("titles")).join(base.hint("merge"), "user_id")
    rows = rows.select("result_id", vector.likeness(F.col("titles"), F.col("h")).alias("p"), vector.likeness(F.col("titles"), F.col("g")).alias("q"))
    total = lambda a: F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x)
    soft = lambda c: total(F.transform(c, F.exp))
    gain = total(F.zip_with("p", "q", lambda p, q: F.exp(p) * (p - q))) / soft("p") - F.log(soft("p") / soft("q"))
    return rows.select("result_id", F.round(gain, 6).alias("gain"))


def best_option(spark, d):
    """The likeliest option of each prompt and its probability; ties go to the earlier letter."""
    return runs.scored(spark, d).groupBy("result_id").agg(F.max_by("letter", F.struct(F.round("p", 9), -F.ascii("letter"))).alias("letter"), F.round(F.max("p"), 6).alias("p"))


# --- samples and batches


def valid_experiences(spark, d):
    """Runs with a prompt and an action that is not blank."""
    kept = (F.coalesce("user_query", F.lit("")) != "") & (F.length(F.trim(F.coalesce("predicted_option", F.lit("")))) > 0)
    return runs.runs(spark, d).where(kept).select("result_id")


def mini_batches(spark, d):
    """The batches of one epoch: runs in the order of a hash, the last batch short."""
    n = sequence.numbered(runs.runs(spark, d).select("result_id", F.md5(F.col("result_id").cast("string")).alias("h")), ["h", "result_id"])
    return n.select("result_id", F.floor((F.col("rank") - 1) / BATCH).cast("long").alias("batch"))


def sample_rows(spark, d):
    """A sample without replacement: the first runs in the order of a hash, all where there are fewer."""
    return runs.runs(spark, d).select("result_id").orderBy(F.md5(F.concat(F.col("result_id").cast("string"), F.lit("s"))), "result_id").limit(SAMPLE)


def dataset_sizes(spark, d):
    """Samples for training, evaluation and testing: nine tenths by hash, then a twentieth each."""
    part = _hash(F.col("result_id").cast("string")) % 20
    side = F.when(part < 18, "train").when(part == 18, "eval").otherwise("test")
    return runs.runs(spark, d).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


# --- agents


def agent_trailing(spark, d):
    """Mean and deviation of each agent's last hundred rewards."""
    last = sequence.latest(runs.agent_rewards(spark, d), ["result_id"], RECENT)
    names = ("selector", "aligner", "recommender", "overall")
    return last.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in names], *[F.round(F.stddev_pop(c), 6).alias(f"{c}_std") for c in names])


def _history(spark, d) -> DataFrame:
    """Per run in order: actions before it, and mean and most of the up to ten rewards before it."""
    a = F.col("action")
    rows = runs._actions(spark, d).join(runs.agent_rewards(spark, d).select("result_id", F.col("overall").alias("reward")), "result_id")
    n = sequence.numbered(rows, ["result_id"], {f"c{k}": (a == k).cast("int") for k in range(1, 5)})
    return sequence.trailing(n, LAST_REWARDS, {"mean": lambda w: F.avg("reward").over(w), "most": lambda w: F.max("reward").over(w)})


def running_rewards(spark, d):
    """Mean and greatest of the last ten rewards before each run; 0 before the first."""
    return _history(spark, d).select("result_id", F.round(F.coalesce("mean", F.lit(0.0)) + 1e-9, 6).alias("avg_reward"), F.round(F.coalesce("most", F.lit(0.0)), 6).alias("max_reward"))  # no mean lies on the edge of rounding


def epsilon_greedy(spark, d):
    """The action of each run under the decaying exploration: a hash decides whether it is any expert or the stored one."""
    n = sequence.numbered(runs._actions(spark, d), ["result_id"])
    epsilon = F.greatest(F.lit(0.1), 0.5 * F.pow(F.lit(0.9995), F.col("rank")))
    named = lambda x: _hash(F.concat(F.col("result_id").cast("string"), F.lit(x)))
    return n.select("result_id", F.when(named("e") / 4294967296.0 < epsilon, named("a") % 4 + 1).otherwise(F.col("action")).cast("long").alias("action"))


def selector_state(spark, d):
    """The selector's state of 64 places before each run, in millionths: query (16), context (16), history (32), each filled up with zeros."""
    q = F.coalesce("user_query", F.lit(""))
    flag = lambda *w: prompts._any(F.lower(q), w).cast("double")
    own = runs.runs(spark, d)
    earlier = sequence.recurrence(own.where("user_id is not null").select("user_id", "result_id"), ["user_id"], "result_id", F.lit(1.0), F.lit(1.0)).select("result_id", (F.col("value") - 1).alias("session"))
    rows = own.select(
        "result_id",
        F.array(F.length(q).cast("double"), F.size(prompts.words(q)).cast("double"), flag("recommend", "suggest"), flag("movie", "film"), flag("actor", "director")).alias("query"),
        (F.hour("created_at") / 24.0).alias("hour"),
    )
    past = _history(spark, d)
    share = lambda k: F.when(F.col("rank") == 1, 0.25).otherwise((F.col(f"c{k}") - (F.col("action") == k).cast("int")) / (F.col("rank") - 1))
    past = past.select("result_id", F.array(*map(share, range(1, 5)), F.coalesce("mean", F.lit(0.0)), F.coalesce("most", F.lit(0.0))).alias("past"))
    rows = rows.join(earlier, "result_id", "left").join(past, "result_id")
    context = F.array(F.coalesce("session", F.lit(0.0)), F.lit(0.5), "hour", F.lit(0.5))
    padded = lambda c, n: F.slice(F.concat(c, F.array_repeat(F.lit(0.0), n)), 1, n)
    state = F.slice(F.concat(padded(F.col("query"), 16), padded(context, 16), padded(F.col("past"), 32)), 1, 64)
    return rows.select("result_id", F.array_join(F.transform(state, lambda x: F.round(x * 1e6 + 1e-3).cast("long").cast("string")), ",").alias("state"))


QUERIES = {f.__name__: f for f in (
    answer_of_run, option_of_generation, sample_preprocess, recent_turns, alignment_prompts, template_explanation, explanation_prompts, recommendation_prompts, mention_words, text_option_distribution, semantic_gain,
    best_option, valid_experiences, mini_batches, sample_rows, dataset_sizes, agent_trailing, running_rewards, epsilon_greedy, selector_state,
)}


def _sql(template: str, **values: str) -> str:
    """The template as an expression of DuckDB: its places by SQL expressions."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return "(" + " || ".join(values[t] if place else quoted(t) for place, t in templates.parts(template)) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(text: str, part: str) -> str:
    return f"coalesce(((length({text}) - length(replace({text}, {part}, ''))) / nullif(length({part}), 0))::bigint, 0)"


EXPLICIT = ", ".join(f"nullif(regexp_extract(u, '{f}', 1), '')" for f in prompts.ANSWER_FORMS)
TASKS = {name: _sql(templates.TASK, instruction=_quoted(a), label=_quoted(b), history="h", options="o", item=_quoted(c)) for name, (a, b, c) in templates.DOMAINS.items()}
KNOW = f"know AS (SELECT result_id, user_id, coalesce(user_query, '') AS q, coalesce({HIST}, '') AS k FROM pipeline_result)"
TURNS = f"""turns AS (SELECT user_id, coalesce(string_agg('User: ' || user_query || chr(10) || 'Bot: ' || predicted_option, chr(10) ORDER BY back DESC) FILTER (coalesce(user_query, '') <> '' AND coalesce(predicted_option, '') <> ''), '') AS turns FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, result_id DESC) AS back FROM pipeline_result WHERE user_id IS NOT NULL) WHERE back <= {LAST_TURNS} GROUP BY 1)"""
SAID = _sql(templates.SAID, query=f"left(q, {templates.MOST_QUERY})", knowledge=f"CASE WHEN length(k) > {templates.MOST_PREVIEW} THEN left(k, {templates.MOST_PREVIEW}) || '...' ELSE k END", preferences="'your preferences'")
PROMPT = {kind: _sql(text, query="q", preferences=_quoted(templates.GENERAL_USER), document="doc", kind="'movie'") for kind, text in templates.ALIGNMENT.items()}
RECOMMENDED = _sql(
    templates.RECOMMENDATION, query="q", user_type=_quoted(templates.GENERAL_TYPE), preferences=_quoted(templates.GENERAL_PREFERENCES), turns=f"CASE WHEN coalesce(turns, '') <> '' THEN {_sql(templates.TURNS, turns='turns')} ELSE '' END",
    knowledge=f"left(k, {templates.MOST_RECOMMENDED})", explanation=SAID, kind="'movie'", item="'movie'", title="'Movie'",
)
PAST = f"""past AS (SELECT result_id, row_number() OVER o AS rank, {", ".join(f"count(*) FILTER (action = {k}) OVER before AS b{k}" for k in range(1, 5))}, avg(reward) OVER last AS mean, max(reward) OVER last AS most
FROM (SELECT a.result_id, action, round(overall, 6) AS reward FROM act a JOIN rew r ON r.result_id = a.result_id) WINDOW o AS (ORDER BY result_id), before AS (ORDER BY result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last AS (ORDER BY result_id ROWS BETWEEN {LAST_REWARDS} PRECEDING AND 1 PRECEDING))"""
_words = "list_filter(string_split_regex(lower(q), '\\s+'), lambda w: w <> '')"
_has = lambda *w: "(" + " OR ".join(f"contains(lower(q), '{x}')" for x in w) + ")::int"
HASH = "('0x' || substr(md5({t}), 1, 8))::bigint"

SQL = {
    "answer_of_run": _with(OPTS, GEN, f"named AS (SELECT result_id, arg_max(letter, (n, -pos)) AS named FROM (SELECT result_id, letter, pos, {_count('upper(t)', 'upper(title)')} AS n FROM opt JOIN gen USING (result_id)) WHERE n > 0 GROUP BY 1)")
    + f"SELECT result_id, CASE WHEN u = '' THEN 'M' ELSE coalesce({EXPLICIT}, named, {runs.ALONE}) END AS letter FROM (SELECT result_id, upper(t) AS u FROM gen) LEFT JOIN named USING (result_id)",
    "option_of_generation": _with(OPTS, GEN, "tidy AS (SELECT result_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM gen)", f"""w AS (SELECT result_id, letter, pos, t, 2 * ({_count('upper(t)', "' ' || letter || ' '")} + {_count('upper(t)', "'(' || letter || ')'")} + {_count('upper(t)', "letter || ':'")}) + {_count('upper(t)', 'left(upper(title), 20)')} AS w FROM opt JOIN tidy USING (result_id))""",
        "per AS (SELECT result_id, list(letter) AS letters, arg_max(letter, (w, -pos)) AS best, max(w) AS w, arg_min(letter, pos) AS first, any_value(t) AS t FROM w GROUP BY 1)")
    + "SELECT result_id, coalesce(CASE WHEN list_contains(letters, upper(right(t, 1))) THEN upper(right(t, 1)) END, " + ", ".join(f"CASE WHEN list_contains(letters, upper(regexp_extract(t, '{f}', 1))) THEN upper(regexp_extract(t, '{f}', 1)) END" for f in prompts.GENERATED_FORMS) + ", CASE WHEN w > 0 THEN best END, first) AS letter FROM per",
    "sample_preprocess": _with(SCORED) + f"""SELECT result_id, CASE WHEN music THEN {TASKS['music']} ELSE {TASKS['movie']} END AS task_prompt, h AS retrieval_query, coalesce(n, 0)::bigint AS n_options, letter AS correct_answer FROM (
      SELECT result_id, {HIST} AS h, regexp_extract(user_query, '(?s)Options:\\s*\\{{(.*)\\}}', 1) AS o, contains(user_query, 'Listening history:') AS music FROM pipeline_result WHERE user_query IS NOT NULL) LEFT JOIN (SELECT result_id, letter, n FROM scored WHERE is_truth) USING (result_id)""",
    "recent_turns": _with(TURNS) + "SELECT * FROM turns",
    "alignment_prompts": f"SELECT result_id, CASE e WHEN 2 THEN {PROMPT['triple']} WHEN 3 THEN {PROMPT['subgraph']} WHEN 4 THEN {PROMPT['connected_graph']} ELSE {PROMPT['direct']} END AS prompt FROM (SELECT result_id, coalesce(user_query, '') AS q, coalesce({HIST}, '') AS doc, coalesce(selected_retriever_id, 1) AS e FROM pipeline_result)",
    "template_explanation": _with(KNOW) + f"SELECT result_id, {SAID} AS text FROM know",
    "explanation_prompts": _with(KNOW) + "SELECT result_id, " + _sql(templates.EXPLANATION, query="q", user_type=_quoted(templates.GENERAL_TYPE), preferences=_quoted(templates.GENERAL_PREFERENCES), knowledge=f"left(k, {templates.MOST_EXPLAINED})") + " AS prompt FROM know",
    "recommendation_prompts": _with(KNOW, TURNS) + f"SELECT result_id, {RECOMMENDED} AS prompt FROM know LEFT JOIN turns USING (user_id)",
    "mention_words": "SELECT doc_id, array_to_string(list_filter(string_split_regex(concat_ws(' ', title, text), '\\s+'), lambda w: length(w) > 4 AND lower(w) NOT IN (" + ", ".join(map(_quoted, prompts.NO_MENTIONS)) + "))[:3], ',') AS mentions FROM documents WHERE text IS NOT NULL",
    "text_option_distribution": _with(OPTS, "named AS (SELECT result_id || '_' || letter AS oid, result_id, letter, title FROM opt)", f"said AS (SELECT result_id::varchar AS rid, {HIST} AS h FROM pipeline_result)", f"tv AS ({BAG.format(id='oid', text='title', src='named')})", f"hv AS ({BAG.format(id='rid', text='h', src='said')})",
        "sims AS (SELECT n.result_id, n.letter, coalesce(sum(tv.x * hv.x), 0.0::double) AS s FROM named n LEFT JOIN tv ON tv.id = n.oid LEFT JOIN hv ON hv.id = n.result_id::varchar AND hv.bucket = tv.bucket GROUP BY 1, 2)", "ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY result_id)) AS e FROM sims)")
    + "SELECT result_id, letter, round(e / sum(e) OVER (PARTITION BY result_id), 6) AS p FROM ex",
    "semantic_gain": _with(OPTS, "named AS (SELECT result_id || '_' || letter AS oid, result_id, letter, title FROM opt)", f"said AS (SELECT result_id::varchar AS rid, {HIST} AS h FROM pipeline_result)", f"tv AS ({BAG.format(id='oid', text='title', src='named')})", f"hv AS ({BAG.format(id='rid', text='h', src='said')})",
        "base AS (SELECT user_id, arg_max(result_id, (created_at, result_id)) AS base_id FROM pipeline_result WHERE coalesce(selected_retriever_id, 1) = 1 AND user_id IS NOT NULL GROUP BY 1)",
        "own AS (SELECT result_id, base_id FROM pipeline_result JOIN base USING (user_id) WHERE coalesce(selected_retriever_id, 1) <> 1)",
        "sims AS (SELECT n.result_id, n.letter, coalesce(sum(tv.x * a.x), 0.0::double) AS p, coalesce(sum(tv.x * b.x), 0.0::double) AS q FROM own JOIN named n USING (result_id) LEFT JOIN tv ON tv.id = n.oid LEFT JOIN hv a ON a.id = n.result_id::varchar AND a.bucket = tv.bucket LEFT JOIN hv b ON b.id = base_id::varchar AND b.bucket = tv.bucket GROUP BY 1, 2)",
        "ex AS (SELECT result_id, exp(p - max(p) OVER w) AS p, exp(q - max(q) OVER w) AS q FROM sims WINDOW w AS (PARTITION BY result_id))", "nx AS (SELECT result_id, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM ex WINDOW w AS (PARTITION BY result_id))")
    + "SELECT result_id, round(sum(p * ln(p / q)), 6) AS gain FROM nx GROUP BY 1",
    "best_option": _with(SCORED) + "SELECT result_id, letter, round(p, 6) AS p FROM scored WHERE rank = 1",
    "valid_experiences": "SELECT result_id FROM pipeline_result WHERE coalesce(user_query, '') <> '' AND length(trim(coalesce(predicted_option, ''))) > 0",
    "mini_batches": f"SELECT result_id, ((row_number() OVER (ORDER BY md5(result_id::varchar), result_id) - 1) // {BATCH})::bigint AS batch FROM pipeline_result",
    "sample_rows": f"SELECT result_id FROM pipeline_result ORDER BY md5(result_id::varchar || 's'), result_id LIMIT {SAMPLE}",
    "dataset_sizes": f"SELECT CASE WHEN p < 18 THEN 'train' WHEN p = 18 THEN 'eval' ELSE 'test' END AS side, count(*) AS n FROM (SELECT {HASH.format(t='result_id::varchar')} % 20 AS p FROM pipeline_result) GROUP BY 1",
    "agent_trailing": _with(REW) + "SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("selector", "aligner", "recommender", "overall")) + " FROM (SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in ("selector", "aligner", "recommender", "overall")) + f" FROM rew ORDER BY result_id DESC LIMIT {RECENT})",
    "running_rewards": _with(ACT, REW, PAST) + "SELECT result_id, round(coalesce(mean, 0) + 1e-9::double, 6) AS avg_reward, round(coalesce(most, 0), 6) AS max_reward FROM past",
    "epsilon_greedy": _with(ACT) + f"""SELECT result_id, (CASE WHEN {HASH.format(t="result_id || 'e'")} / 4294967296.0::double < greatest(0.1::double, 0.5::double * pow(0.9995::double, rank)) THEN {HASH.format(t="result_id || 'a'")} % 4 + 1 ELSE action END)::bigint AS action FROM act""",
    "selector_state": _with(ACT, REW, PAST) + f"""SELECT result_id, array_to_string(list_transform(list_resize([length(q), len({_words}), {_has('recommend', 'suggest')}, {_has('movie', 'film')}, {_has('actor', 'director')}]::double[], 16, 0.0::double)
        || list_resize([session, 0.5, hour / 24.0::double, 0.5]::double[], 16, 0.0::double) || list_resize([{", ".join(f"CASE WHEN rank = 1 THEN 0.25::double ELSE b{k} / (rank - 1)::double END" for k in range(1, 5))}, coalesce(mean, 0), coalesce(most, 0)]::double[], 32, 0.0::double), lambda x: round(x * 1e6 + 1e-3::double)::bigint), ',') AS state
      FROM (SELECT result_id, coalesce(user_query, '') AS q, hour(created_at AT TIME ZONE 'UTC') AS hour, CASE WHEN user_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY user_id ORDER BY result_id) - 1 END AS session FROM pipeline_result) JOIN past USING (result_id)""",
}
