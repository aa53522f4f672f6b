"""Queries over stored runs: prompts, answers, scores, accuracy, rewards, windows; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselkg.functions import prompts
from tesselkg.operators import sequence
from tesselkg.plans.knowledge import _with
from tesselkg.session import table

# Weights, costs and decays.
RELEVANCE, DIVERSITY, QUALITY = 0.4, 0.3, 0.3
COSTS, OTHER_COST = {1: 0.0, 2: 0.1, 3: 0.2, 4: 0.3}, 0.5
LAMBDA, ETA, WRONG = 0.2, 0.005, -0.1
GAMMA = 0.99
HARD_NEGATIVES, BETA = 10, 0.1


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pipeline_result")


def options(spark, d) -> DataFrame:
    """(result_id, letter, title, pos) of the options of each stored prompt; of a repeated letter the last title holds."""
    rows = runs(spark, d).select("result_id", F.posexplode(prompts.options_list(prompts.options_text(F.col("user_query")))).alias("pos", "o"))
    last = rows.groupBy("result_id", F.col("o.letter").alias("letter")).agg(F.max_by("o.title", "pos").alias("title"), F.min("pos").alias("pos"))
    return last


OPTS = r"""otxt AS (SELECT result_id, regexp_extract(user_query, '(?s)Options:\s*\{(.*)\}', 1) AS o FROM pipeline_result),
opart AS (SELECT result_id, unnest(string_split(regexp_replace(o, ', ([A-Ta-t]: )', chr(1) || '\1', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(o, ', ([A-Ta-t]: )', chr(1) || '\1', 'g'), chr(1)), 1) AS pos FROM otxt),
opt AS (SELECT result_id, letter, arg_max(title, pos) AS title, min(pos) AS pos FROM (SELECT result_id, pos, upper(trim(split_part(trim(part), ': ', 1))) AS letter, trim(trim(part)[strpos(trim(part), ': ') + 2:]) AS title FROM opart WHERE contains(trim(part), ': '))
  WHERE length(letter) = 1 AND contains('ABCDEFGHIJKLMNOPQRST', letter) GROUP BY 1, 2)"""
HIST = r"regexp_extract(user_query, '(?s)(?:Watching|Listening) history:\s*\{(.*?)\}\.?\s*Options:', 1)"


def options_parse(spark, d):
    return options(spark, d).select("result_id", "letter", "title")


def history_extract(spark, d):
    return runs(spark, d).where("user_query is not null").select("result_id", prompts.history_summary(F.col("user_query")).alias("history"))


def answer_extract(spark, d):
    """The letter found in each document's text taken as generated: explicit forms first, then a lone letter, then the default."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.when(text == "", prompts.DEFAULT_ANSWER).otherwise(F.coalesce(prompts.explicit_answer(text), prompts.lone_letter(text))).alias("letter"))


def option_mentions(spark, d):
    """The most mentioned option title of each prompt in its own history (ties to the earlier option); none without a mention."""
    h = runs(spark, d).select("result_id", F.upper(prompts.history_text(F.col("user_query"))).alias("h"))
    rows = options(spark, d).join(h, "result_id").withColumn("n", prompts.count_of(F.col("h"), F.upper("title"))).where("n > 0")
    return rows.groupBy("result_id").agg(F.max_by("letter", F.struct("n", -F.col("pos"))).alias("letter"), F.max("n").alias("n"))


def option_prompt(spark, d):
    """The prompt that asks for one letter: options cut and in letter order, the history part, no knowledge."""
    listed = options(spark, d).groupBy("result_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("letter", F.concat("letter", F.lit(":"), F.substring("title", 1, prompts.MOST_TITLE)).alias("t")))), lambda x: x["t"]), " ").alias("o"))
    q = F.col("user_query")
    start = F.instr(q, F.lit("Watching history:"))
    history = F.when(start > 0, F.trim(F.regexp_replace(F.substring_index(F.substr(q, start), "Options:", 1), r"^\s+|\s+$", ""))).otherwise(F.substring(q, 1, prompts.MOST_HISTORY))
    rows = runs(spark, d).where("user_query is not null").select("result_id", history.alias("h")).join(listed, "result_id")
    begin, middle, end = map(F.lit, prompts.OPTION_PROMPT)
    text = F.concat(begin, "h", middle, "o", end)
    return rows.select("result_id", text.alias("prompt"))


def retrieval_types(spark, d):
    return table(spark, d, "documents").groupBy(prompts.retrieval_type(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def text_quality_scores(spark, d):
    """Confidence, diversity and quality of each document's text as a recommendation, and its quality as an explanation, for its title as the query and title and note as knowledge."""
    docs = table(spark, d, "documents").where("text is not null and text != ''")
    rows = docs.select("doc_id", "text", prompts.words(F.col("text")).alias("w"), F.array_distinct(prompts.words(F.coalesce("title", F.lit("")))).alias("q"), F.array_distinct(prompts.words(F.concat_ws(" ", "title", "edit_note"))).alias("k"))
    rows = rows.withColumn("u", F.array_distinct("w"))
    return rows.select(
        "doc_id",
        F.round(prompts.generation_confidence(F.col("text"), F.col("u"), F.col("k")), 6).alias("confidence"),
        F.round(prompts.diversity(F.col("text"), F.col("w"), F.col("u")), 6).alias("diversity"),
        F.round(prompts.quality(F.col("text"), F.col("u"), F.col("q")), 6).alias("quality"),
        F.round(prompts.explanation_quality(F.col("text"), F.col("u"), F.col("k")), 6).alias("explanation"),
    )


def word_overlap(spark, d):
    """Distinct words that each document shares with its title."""
    docs = table(spark, d, "documents").where("text is not null and title is not null")
    return docs.select("doc_id", F.size(F.array_intersect(F.array_distinct(prompts.words(F.col("text"))), F.array_distinct(prompts.words(F.col("title"))))).cast("long").alias("n"))


def scored(spark, d) -> DataFrame:
    """Options with keyword scores against the prompt's history, their probability, rank and the truth (chosen by a hash of the result)."""
    h = runs(spark, d).select("result_id", F.lower(prompts.history_text(F.col("user_query"))).alias("h"))
    rows = options(spark, d).join(h, "result_id")
    score = F.aggregate(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) > 0), F.lit(0), lambda a, w: a + F.contains(F.col("h"), w).cast("int"))
    rows = rows.select("result_id", "letter", "pos", score.cast("long").alias("score"))
    per = Window.partitionBy("result_id")  # at most twenty options
    p = F.greatest("score", F.lit(1)) / F.sum(F.greatest("score", F.lit(1))).over(per)
    rows = rows.select("*", p.alias("p"), F.row_number().over(per.orderBy("letter")).alias("k"), F.count(F.lit(1)).over(per).alias("n"))
    rank = F.row_number().over(per.orderBy(F.desc(F.round("p", 9)), "letter"))
    truth = F.pmod(F.conv(F.substring(F.md5(F.col("result_id").cast("string")), 1, 8), 16, 10).cast("long"), F.col("n")) + 1
    return rows.select("result_id", "letter", "score", F.round("p", 9).alias("p"), rank.cast("long").alias("rank"), (F.col("k") == truth).alias("is_truth"), "n")


SCORED = OPTS + f""", hist AS (SELECT result_id, lower({HIST}) AS h FROM pipeline_result),
sc AS (SELECT o.result_id, letter, pos, (SELECT count(*) FROM (SELECT unnest(string_split_regex(lower(title), '\\s+')) AS w) WHERE w <> '' AND contains(h, w)) AS score FROM opt o JOIN hist USING (result_id)),
sp AS (SELECT *, round(greatest(score, 1) / sum(greatest(score, 1)) OVER (PARTITION BY result_id), 9) AS p, row_number() OVER (PARTITION BY result_id ORDER BY letter) AS k, count(*) OVER (PARTITION BY result_id) AS n FROM sc),
scored AS (SELECT result_id, letter, score, p, n, row_number() OVER (PARTITION BY result_id ORDER BY p DESC, letter) AS rank, k = ('0x' || substr(md5(result_id::varchar), 1, 8))::bigint % n + 1 AS is_truth FROM sp)"""


def keyword_option_scores(spark, d):
    return scored(spark, d).select("result_id", "letter", "score", F.round("p", 6).alias("p"))


def topk_accuracy(spark, d):
    """Accuracy at 1, 3 and 5 over the successful runs, a hit at 1 counting for all; and the failures."""
    truth = scored(spark, d).where("is_truth").select("result_id", F.col("letter").alias("truth"), "rank")
    rows = runs(spark, d).select("result_id", "pipeline_success", "predicted_option").join(truth, "result_id", "left")
    ok = F.coalesce("pipeline_success", F.lit(False))
    top = F.coalesce("predicted_option", F.lit("A")) == F.col("truth")
    at = lambda k: F.round(F.coalesce(F.count_if(ok & (top | (F.col("rank") <= k))) / F.nullif(F.count_if(ok), F.lit(0)), F.lit(0.0)), 6)
    return rows.agg(at(0).alias("top1"), at(3).alias("top3"), at(5).alias("top5"), F.count_if(ok).alias("n"), F.count_if(~ok).alias("n_failed"))


def expert_usage(spark, d):
    used = runs(spark, d).where("pipeline_success").groupBy(F.coalesce("selected_retriever_id", F.lit(1)).alias("expert_id")).agg(F.count(F.lit(1)).alias("n"))
    total = used.agg(F.sum("n").alias("t"))
    return used.join(F.broadcast(total)).select("expert_id", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("percent"))  # one row


def expert_entropy(spark, d):
    """Entropy of the experts' use in bits, and against its most for the experts used."""
    used = expert_usage(spark, d).withColumn("p", F.col("percent") / 100)
    e = used.agg(F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0)).alias("e"), F.count(F.lit(1)).alias("k"))
    return e.select(F.round("e", 4).alias("entropy"), F.round(F.col("e") / F.when(F.col("k") > 1, F.log2("k")).otherwise(1.0), 4).alias("normalised"))


def batch_evaluation(spark, d):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.when(F.col("pipeline_success"), RELEVANCE * z("generation_confidence") + DIVERSITY * z("diversity_score") + QUALITY * z("quality_score")).otherwise(0.0)
    rows = runs(spark, d).select(score.alias("s"), F.coalesce("pipeline_success", F.lit(False)).alias("ok"))
    return rows.agg(F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 6).alias("avg_score"), F.round(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)), 6).alias("success_rate"), F.count(F.lit(1)).alias("total"))


def agent_rewards(spark, d):
    """Rewards of the agents per run: confidences combined, selector as their mean, all -1 for a failed run."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    aligner, recommender = z("refinement_confidence"), (z("generation_confidence") + z("diversity_score") + z("quality_score")) / 3
    selector = (aligner + recommender) / 2
    ok = F.coalesce("pipeline_success", F.lit(False))
    of = lambda c: F.round(F.when(ok, c).otherwise(-1.0), 6)
    return runs(spark, d).select("result_id", of(selector).alias("selector"), of(aligner).alias("aligner"), of(recommender).alias("recommender"), of((selector + aligner + recommender) / 3).alias("overall"))


def softmax_distribution(spark, d):
    """Softmax of the options' keyword scores, shifted by their greatest."""
    per = Window.partitionBy("result_id")
    rows = scored(spark, d).withColumn("e", F.exp(F.col("score") - F.max("score").over(per)))
    return rows.select("result_id", "letter", F.round(F.col("e") / F.sum("e").over(per), 6).alias("p"))


def _baselines(spark, d, base_id: Column | str = "result_id") -> DataFrame:
    """(user_id, base_id): each user's newest run of expert 1, the baseline of their other runs; or another value of that run."""
    first = runs(spark, d).where((F.coalesce("selected_retriever_id", F.lit(1)) == 1) & F.col("user_id").isNotNull())
    return first.groupBy("user_id").agg(F.max_by(base_id, F.struct("created_at", "result_id")).alias("base_id"))


def kl_gain(spark, d):
    """Information gain of each run of experts 2 to 4 over its user's baseline run: the divergence of their distributions over the run's letters.

    A letter that the baseline lacks counts 1/n there; both sides are normalised,
    clipped and normalised again. Runs without a baseline have no row.
    """
    eps = 1e-10
    per = Window.partitionBy("result_id")  # at most twenty letters
    s = scored(spark, d)
    own = runs(spark, d).where(F.coalesce("selected_retriever_id", F.lit(1)) != 1).select("result_id", "user_id").join(_baselines(spark, d), "user_id")
    base = s.select(F.col("result_id").alias("base_id"), "letter", F.col("p").alias("q"))
    rows = s.select("result_id", "letter", "p", "n").join(own, "result_id").join(base, ["base_id", "letter"], "left")
    rows = rows.select("result_id", "p", F.coalesce("q", 1.0 / F.col("n")).alias("q"))
    share = lambda c: F.col(c) / F.sum(c).over(per)
    rows = rows.select("result_id", *[F.least(F.greatest(share(c), F.lit(eps)), F.lit(1.0)).alias(c) for c in ("p", "q")])
    rows = rows.select("result_id", share("p").alias("p"), share("q").alias("q"))
    return rows.groupBy("result_id").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 6).alias("gain"))


def total_reward(spark, d):
    """Recommendation reward plus weighted marginal gain less cost; no gain for the baseline expert or without a baseline run; 0 for failures."""
    truth = scored(spark, d).where("is_truth").select("result_id", F.col("letter").alias("truth"))
    rows = runs(spark, d).join(truth, "result_id").join(kl_gain(spark, d), "result_id", "left")
    expert = F.coalesce("selected_retriever_id", F.lit(1))
    cost = F.lit(OTHER_COST)
    for k, c in COSTS.items():
        cost = F.when(expert == k, F.lit(c)).otherwise(cost)
    rec = F.when(F.coalesce("predicted_option", F.lit("A")) == F.col("truth"), F.coalesce("generation_confidence", F.lit(1.0))).otherwise(WRONG)
    mig = F.when((expert == 1) | F.col("gain").isNull(), 0.0).otherwise(F.col("gain") - ETA * cost)
    ok = F.coalesce("pipeline_success", F.lit(False))
    of = lambda c: F.round(F.when(ok, c).otherwise(0.0), 6)
    return rows.select("result_id", of(rec).alias("r_rec"), of(mig).alias("r_mig"), of(rec + LAMBDA * mig).alias("r_total"), of(rec - ETA * cost).alias("r_simple"))


def hard_negatives(spark, d):
    """The likeliest wrong options of each prompt, ten at most."""
    wrong = scored(spark, d).where("not is_truth")
    rank = F.row_number().over(Window.partitionBy("result_id").orderBy(F.desc("p"), "letter"))
    return wrong.withColumn("place", rank.cast("long")).where(F.col("place") <= HARD_NEGATIVES).select("result_id", "letter", "place")


def preference_loss(spark, d):
    """Mean -log sigmoid(beta * margin) of the truth's log-probability over each hard negative's."""
    s = scored(spark, d)
    won = s.where("is_truth").select("result_id", F.log("p").alias("w"))
    lost = s.join(hard_negatives(spark, d), ["result_id", "letter"]).select("result_id", F.log("p").alias("l"))
    loss = lost.join(won, "result_id").select((-F.log(1 / (1 + F.exp(-BETA * (F.col("w") - F.col("l")))))).alias("x"))
    return loss.agg(F.round(F.avg("x"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


# --- sequences of runs


def _steps(spark, d) -> DataFrame:
    """events as steps: reward, success, and the user's day as trajectory."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.to_date("ts").alias("day"), (F.coalesce("value", F.lit(0.0)) / 100).alias("reward"), (F.col("event_type") != "error").alias("success"), "event_type")


STEPS = "steps AS (SELECT event_id, user_id, ts::date AS day, coalesce(value, 0.0) / 100 AS reward, event_type <> 'error' AS success, event_type FROM events)"


def moving_average(spark, d):
    out = sequence.moving_average(_steps(spark, d), ["event_id"], F.col("reward"), 50)
    return out.select("rank", F.round("average", 6).alias("average"))


def recent_performance(spark, d):
    last = sequence.latest(_steps(spark, d), ["event_id"], 100)
    return last.agg(F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.round(F.avg("reward"), 6).alias("avg_reward"), F.round(F.stddev_pop("reward"), 6).alias("std_reward"))


def metrics_summary(spark, d):
    r = F.col("reward")
    best = F.max_by("event_id", F.struct(F.round("reward", 9), -F.col("event_id")))
    return _steps(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("std"), F.round(F.min(r), 6).alias("least"), F.round(F.max(r), 6).alias("most"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), best.alias("best_episode"))


def train_test_split(spark, d):
    """Rows before the split position train, the others test."""
    n = sequence.numbered(runs(spark, d).select("result_id"), ["result_id"])
    size = n.agg(F.max("rank").alias("n"))
    side = F.when(F.col("rank") <= F.floor(F.col("n") * 0.9), "train").otherwise("test")
    return n.join(F.broadcast(size)).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("rows"), F.min("result_id").alias("first_id"), F.max("result_id").alias("last_id"))


def circular_batch(spark, d):
    """The batch of an epoch as a slice that wraps to the head once (epoch 7 of 300 rows)."""
    n = sequence.numbered(runs(spark, d).select("result_id"), ["result_id"])
    size = n.agg(F.max("rank").alias("n"))
    at = F.pmod(F.lit(7 * 300), F.col("n"))
    rows = n.join(F.broadcast(size))
    tail = rows.where((F.col("rank") > at) & (F.col("rank") <= at + 300))
    head = rows.where((at + 300 > F.col("n")) & (F.col("rank") <= at + 300 - F.col("n")))
    return tail.select("result_id").unionByName(head.select("result_id"))


def epoch_stats(spark, d):
    """Per epoch of 100 runs: mean overall reward, success rate, accuracy at 1, 3 and 5 (a hit at 1 counts for all)."""
    n = sequence.numbered(agent_rewards(spark, d), ["result_id"]).withColumn("epoch", F.floor((F.col("rank") - 1) / 100).cast("long"))
    truth = scored(spark, d).where("is_truth").select("result_id", F.col("letter").alias("truth"), F.col("rank").alias("place"))
    said = runs(spark, d).select("result_id", F.coalesce("predicted_option", F.lit("A")).alias("said")).join(truth, "result_id", "left")
    n = n.join(said, "result_id", "left")
    top = F.coalesce(F.col("said") == F.col("truth"), F.lit(False))
    hit = lambda k: F.round(F.avg((top | F.coalesce(F.col("place") <= k, F.lit(False))).cast("double")), 6).alias(f"top{max(k, 1)}")
    return n.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 6).alias("avg_reward"), F.round(F.avg((F.col("overall") > -1).cast("double")), 6).alias("success_rate"), hit(0), hit(3), hit(5))


def gae_advantages(spark, d):
    """Advantages along each user's day: reward plus discounted next value (0.4) less value (0.5), the day's last step done."""
    s = _steps(spark, d)
    last = s.groupBy("user_id", "day").agg(F.max("event_id").alias("last"))
    s = s.join(last, ["user_id", "day"]).withColumn("done", F.col("event_id") == F.col("last"))
    s = s.withColumn("delta", F.col("reward") + F.when(F.col("done"), 0.0).otherwise(GAMMA * 0.4) - 0.5)
    return sequence.generalized_advantages(s, ["user_id", "day"], "event_id").select("event_id", F.round(F.col("advantage") + 1e-9, 6).alias("advantage"))  # no value lies on the edge of rounding


def td_advantage(spark, d):
    s = _steps(spark, d)
    target = F.col("reward") + F.when(F.col("success"), GAMMA * 0.4).otherwise(0.0)
    return s.select("event_id", F.round(target, 6).alias("target"), F.round(target - 0.5, 6).alias("advantage"))


def normalised_advantages(spark, d):
    """Rewards less the mean, over the sample deviation where there is any."""
    s = _steps(spark, d)
    m = s.agg(F.avg("reward").alias("m"), F.stddev_samp("reward").alias("sd"))
    return s.join(F.broadcast(m)).select("event_id", F.round(F.when(F.col("sd") > 1e-8, (F.col("reward") - F.col("m")) / (F.col("sd") + 1e-8)).otherwise(F.col("reward") - F.col("m")), 5).alias("z"))


def ema_series(spark, d):
    """The exponential baseline of each event type after every step, from 0: a tenth of the reward, nine tenths of the baseline before."""
    out = sequence.recurrence(_steps(spark, d), ["event_type"], "event_id", F.lit(0.9), 0.1 * F.col("reward"))
    return out.select("event_type", "event_id", F.round(F.col("value") + 1e-9, 6).alias("baseline"))


def ema_baseline(spark, d):
    """The baseline after each event type's last step."""
    return ema_series(spark, d).groupBy("event_type").agg(F.max_by("baseline", "event_id").alias("baseline"))


def epsilon_schedule(spark, d):
    n = sequence.numbered(runs(spark, d).select("result_id"), ["result_id"])
    return n.select("result_id", F.round(F.greatest(F.lit(0.1), 0.5 * F.pow(F.lit(0.9995), F.col("rank"))), 6).alias("epsilon"))


def _actions(spark, d) -> DataFrame:
    return runs(spark, d).select("result_id", F.coalesce("selected_retriever_id", F.lit(1)).alias("action"))


def running_action_distribution(spark, d):
    """Share of each expert among the runs before; uniform before the first."""
    a = F.col("action")
    n = sequence.numbered(_actions(spark, d), ["result_id"], {f"c{k}": (a == k).cast("int") for k in range(1, 5)})
    share = lambda k: F.round(F.when(F.col("rank") == 1, 0.25).otherwise((F.col(f"c{k}") - (a == k).cast("int")) / (F.col("rank") - 1)), 6)
    return n.select("result_id", *[share(k).alias(f"p{k}") for k in range(1, 5)])


def exploration_bonus(spark, d):
    a = F.col("action")
    n = sequence.numbered(_actions(spark, d), ["result_id"], {f"c{k}": (a == k).cast("int") for k in range(1, 5)})
    seen = F.lit(0.0)
    for k in range(1, 5):
        seen = F.when(a == k, F.col(f"c{k}")).otherwise(seen)
    return n.select("result_id", F.round(0.2 / F.sqrt(seen + 1), 6).alias("bonus"))


def conversation_satisfaction(spark, d):
    """Mean satisfaction of each user's last three queries; the newest rows of a user are kept per task first."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("result_id")))
    rows = runs(spark, d).where("user_id is not null").select("user_id", "created_at", "result_id", F.coalesce("user_query", F.lit("")).alias("q")).withColumn("r", rank).where("r <= 3")
    return rows.groupBy("user_id").agg(F.round(F.avg(prompts.satisfaction(F.col("q"))), 6).alias("satisfaction"))


def query_state_vector(spark, d):
    """The used places of the selector's state: length, words, three flags of the query, and the hour of the day."""
    q = F.coalesce("user_query", F.lit(""))
    flag = lambda *w: prompts._any(F.lower(q), w).cast("long")
    return runs(spark, d).select("result_id", F.length(q).cast("long").alias("length"), F.size(prompts.words(q)).cast("long").alias("words"), flag("recommend", "suggest").alias("asks"), flag("movie", "film").alias("movie"), flag("actor", "director").alias("person"), F.round(F.hour("created_at") / 24.0, 6).alias("hour"))


QUERIES = {f.__name__: f for f in (
    options_parse, history_extract, answer_extract, option_mentions, option_prompt, retrieval_types, text_quality_scores, word_overlap, keyword_option_scores, topk_accuracy, expert_usage, expert_entropy,
    batch_evaluation, agent_rewards, softmax_distribution, kl_gain, total_reward, hard_negatives, preference_loss, moving_average, recent_performance, metrics_summary, train_test_split, circular_batch,
    epoch_stats, gae_advantages, td_advantage, normalised_advantages, ema_series, ema_baseline, epsilon_schedule, running_action_distribution, exploration_bonus, conversation_satisfaction, query_state_vector,
)}

WORDS = r"list_filter(string_split_regex(lower({t}), '\s+'), lambda w: w <> '')"
ANY = lambda t, parts: "(" + " OR ".join(f"contains({t}, '{p}')" for p in parts) + ")"
HITS = lambda t, parts: "(" + " + ".join(f"contains({t}, '{p}')::int" for p in parts) + ")"
COST = "CASE coalesce(selected_retriever_id, 1) WHEN 1 THEN 0.0::double WHEN 2 THEN 0.1::double WHEN 3 THEN 0.2::double WHEN 4 THEN 0.3::double ELSE 0.5::double END"
ALONE = "CASE " + " ".join(f"WHEN contains(u, ' {x} ') OR contains(u, ' {x}.') THEN '{x}'" for x in prompts.LETTERS) + " ELSE 'M' END"
KL = """base AS (SELECT user_id, arg_max(result_id, (created_at, result_id)) AS base_id FROM pipeline_result WHERE coalesce(selected_retriever_id, 1) = 1 AND user_id IS NOT NULL GROUP BY 1),
kl0 AS (SELECT e.result_id, e.p, coalesce(b.p, 1.0::double / e.n) AS q FROM scored e JOIN pipeline_result r ON r.result_id = e.result_id AND coalesce(r.selected_retriever_id, 1) <> 1 JOIN base USING (user_id) LEFT JOIN scored b ON b.result_id = base_id AND b.letter = e.letter),
kl1 AS (SELECT result_id, least(greatest(p / sum(p) OVER (PARTITION BY result_id), 1e-10), 1.0::double) AS p, least(greatest(q / sum(q) OVER (PARTITION BY result_id), 1e-10), 1.0::double) AS q FROM kl0),
kl AS (SELECT result_id, round(sum(p * ln(p / q)), 6) AS gain FROM (SELECT result_id, p / sum(p) OVER (PARTITION BY result_id) AS p, q / sum(q) OVER (PARTITION BY result_id) AS q FROM kl1) GROUP BY 1)"""
HARD = "hard AS (SELECT * FROM (SELECT result_id, letter, row_number() OVER (PARTITION BY result_id ORDER BY p DESC, letter) AS place FROM scored WHERE NOT is_truth) WHERE place <= 10)"
REW = """rew AS (SELECT result_id, CASE WHEN pipeline_success THEN (a + r) / 2 ELSE -1.0::double END AS selector, CASE WHEN pipeline_success THEN a ELSE -1.0::double END AS aligner, CASE WHEN pipeline_success THEN r ELSE -1.0::double END AS recommender,
  CASE WHEN pipeline_success THEN ((a + r) / 2 + a + r) / 3 ELSE -1.0::double END AS overall FROM (SELECT *, coalesce(refinement_confidence, 0.0::double) AS a, (coalesce(generation_confidence, 0.0::double) + coalesce(diversity_score, 0.0::double) + coalesce(quality_score, 0.0::double)) / 3 AS r FROM pipeline_result))"""
EMA = """, s AS (SELECT event_type, event_id, reward, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM steps),
e AS (SELECT event_type, event_id, k, 0.1::double * reward AS b FROM s WHERE k = 1 UNION ALL SELECT s.event_type, s.event_id, s.k, 0.9::double * e.b + 0.1::double * s.reward FROM e JOIN s ON s.event_type = e.event_type AND s.k = e.k + 1) """
ACT = "act AS (SELECT result_id, coalesce(selected_retriever_id, 1) AS action, row_number() OVER (ORDER BY result_id) AS rank FROM pipeline_result)"

SQL = {
    "options_parse": _with(OPTS) + "SELECT result_id, letter, title FROM opt",
    "history_extract": r"""SELECT result_id, CASE WHEN i <> '' THEN CASE WHEN len(t) > 0 THEN 'movies: ' || array_to_string(t, ', ') ELSE 'movies: ' || i END WHEN len(l) > 0 THEN 'movies: ' || array_to_string(l, ', ') ELSE '' END AS history FROM (
      SELECT result_id, regexp_extract(user_query, '(?:Watching|Listening) history:\s*\{([^}]+)\}', 1) AS i, regexp_extract_all(regexp_extract(user_query, '(?:Watching|Listening) history:\s*\{([^}]+)\}', 1), '"([^"]+)"', 1) AS t,
        regexp_extract_all(CASE WHEN strpos(user_query, 'Options:') > 1 THEN split_part(user_query, 'Options:', 1) ELSE user_query END, '"([^"]+)"', 1)[:10] AS l FROM pipeline_result WHERE user_query IS NOT NULL)""",
    "answer_extract": "SELECT doc_id, CASE WHEN u = '' THEN 'M' ELSE coalesce(" + ", ".join(f"nullif(regexp_extract(u, '{f}', 1), '')" for f in prompts.ANSWER_FORMS) + f", {ALONE}) END AS letter FROM (SELECT doc_id, upper(coalesce(text, '')) AS u FROM documents)",
    "option_mentions": _with(OPTS) + f"""SELECT result_id, arg_max(letter, (n, -pos)) AS letter, max(n) AS n FROM (SELECT o.result_id, letter, pos, ((length(h) - length(replace(h, upper(title), ''))) / nullif(length(title), 0))::bigint AS n FROM opt o JOIN (SELECT result_id, upper({HIST}) AS h FROM pipeline_result) USING (result_id)) WHERE n > 0 GROUP BY 1""",
    "option_prompt": _with(OPTS) + r"""SELECT result_id, 'Based on the user''s watching history, select the best movie from options A-T.' || chr(10) || chr(10) || h || chr(10) || chr(10) || 'Options: ' || o || chr(10) || chr(10) || 'Answer with ONE letter (A-T): Analysis and Answer:' AS prompt FROM (
      SELECT result_id, CASE WHEN strpos(user_query, 'Watching history:') > 0 THEN regexp_replace(split_part(user_query[strpos(user_query, 'Watching history:'):], 'Options:', 1), '^\s+|\s+$', '', 'g') ELSE left(user_query, 500) END AS h FROM pipeline_result WHERE user_query IS NOT NULL)
      JOIN (SELECT result_id, string_agg(letter || ':' || left(title, 30), ' ' ORDER BY letter) AS o FROM opt GROUP BY 1) USING (result_id)""",
    "retrieval_types": """SELECT CASE WHEN coalesce(text, '') = '' THEN 'direct' WHEN contains(text, 'Retrieved factual triples:') THEN 'triple' WHEN contains(text, 'relevant entities and their 2-hop subgraphs') THEN 'subgraph'
      WHEN contains(text, 'Connected subgraph') OR contains(text, 'Connected graph') THEN 'connected_graph' ELSE 'subgraph' END AS kind, count(*) AS n FROM documents GROUP BY 1""",
    "text_quality_scores": f"""SELECT doc_id, CASE WHEN len(k) = 0 THEN 0.0::double ELSE round((least(1.0::double, length(text) / 300.0::double) * 0.8::double + 0.2::double + least(1.0::double, 2.0::double * len(list_intersect(u, k)) / greatest(len(u), 1)) + CASE WHEN {ANY('text', ('1.', '2.', '•', '-'))} THEN 0.8::double ELSE 0.4::double END) / 3, 6) END AS confidence,
      round((least(1.0::double, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[1-9]\\.'))) / 3.0::double) + len(u)::double / greatest(len(w), 1) + least(1.0::double, {HITS('lower(text)', prompts.THEMES)} / 3.0::double)) / 3, 6) AS diversity,
      CASE WHEN len(q) = 0 THEN 0.0::double ELSE round((len(list_intersect(q, u))::double / greatest(len(q), 1) + CASE WHEN {ANY('lower(text)', prompts.REASONS)} THEN 0.8::double ELSE 0.4::double END + CASE WHEN {ANY('text', ('1.', '2.', '3.'))} THEN 0.8::double ELSE 0.3::double END) / 3, 6) END AS quality,
      round((least(1.0::double, length(text) / 150.0::double) * 0.8::double + 0.2::double + least(1.0::double, 2.0::double * len(list_intersect(u, k)) / greatest(len(u), 1)) + least(1.0::double, {HITS('lower(text)', prompts.ANALYSIS)} / 3.0::double)) / 3, 6) AS explanation
      FROM (SELECT doc_id, text, {WORDS.format(t='text')} AS w, list_distinct({WORDS.format(t='text')}) AS u, list_distinct({WORDS.format(t="coalesce(title, '')")}) AS q, list_distinct({WORDS.format(t="concat_ws(' ', title, edit_note)")}) AS k FROM documents WHERE text <> '')""",
    "word_overlap": f"SELECT doc_id, len(list_intersect(list_distinct({WORDS.format(t='text')}), list_distinct({WORDS.format(t='title')}))) AS n FROM documents WHERE text IS NOT NULL AND title IS NOT NULL",
    "keyword_option_scores": _with(SCORED) + "SELECT result_id, letter, score, round(p, 6) AS p FROM scored",
    "topk_accuracy": _with(SCORED) + """SELECT round(coalesce(count(*) FILTER (ok AND top) / nullif(count(*) FILTER (ok), 0), 0.0::double), 6) AS top1, round(coalesce(count(*) FILTER (ok AND (top OR rank <= 3)) / nullif(count(*) FILTER (ok), 0), 0.0::double), 6) AS top3,
      round(coalesce(count(*) FILTER (ok AND (top OR rank <= 5)) / nullif(count(*) FILTER (ok), 0), 0.0::double), 6) AS top5, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS n_failed FROM (
      SELECT coalesce(pipeline_success, false) AS ok, coalesce(predicted_option, 'A') = letter AS top, rank FROM pipeline_result LEFT JOIN (SELECT result_id, letter, rank FROM scored WHERE is_truth) USING (result_id))""",
    "expert_usage": "SELECT coalesce(selected_retriever_id, 1) AS expert_id, count(*) AS n, round(100.0::double * count(*) / sum(count(*)) OVER (), 4) AS percent FROM pipeline_result WHERE pipeline_success GROUP BY 1",
    "expert_entropy": """SELECT round(coalesce(-sum(p * log2(p)), 0.0::double), 4) AS entropy, round(coalesce(-sum(p * log2(p)), 0.0::double) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1.0::double END, 4) AS normalised
      FROM (SELECT round(100.0::double * count(*) / sum(count(*)) OVER (), 4) / 100 AS p FROM pipeline_result WHERE pipeline_success GROUP BY coalesce(selected_retriever_id, 1))""",
    "batch_evaluation": """SELECT round(avg(CASE WHEN pipeline_success THEN 0.4::double * coalesce(generation_confidence, 0) + 0.3::double * coalesce(diversity_score, 0) + 0.3::double * coalesce(quality_score, 0) ELSE 0.0::double END), 6) AS avg_score,
      round(avg(coalesce(pipeline_success, false)::int), 6) AS success_rate, count(*) AS total FROM pipeline_result""",
    "agent_rewards": _with(REW) + "SELECT result_id, round(selector, 6) AS selector, round(aligner, 6) AS aligner, round(recommender, 6) AS recommender, round(overall, 6) AS overall FROM rew",
    "softmax_distribution": _with(SCORED) + "SELECT result_id, letter, round(e / sum(e) OVER (PARTITION BY result_id), 6) AS p FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY result_id))::double) AS e FROM scored)",
    "kl_gain": _with(SCORED, KL) + "SELECT result_id, gain FROM kl",
    "total_reward": _with(SCORED, KL) + f"""SELECT result_id, round(CASE WHEN ok THEN rec ELSE 0.0::double END, 6) AS r_rec, round(CASE WHEN ok THEN mig ELSE 0.0::double END, 6) AS r_mig, round(CASE WHEN ok THEN rec + 0.2::double * mig ELSE 0.0::double END, 6) AS r_total, round(CASE WHEN ok THEN rec - 0.005::double * cost ELSE 0.0::double END, 6) AS r_simple FROM (
      SELECT result_id, coalesce(pipeline_success, false) AS ok, CASE WHEN coalesce(predicted_option, 'A') = letter THEN coalesce(generation_confidence, 1.0::double) ELSE -0.1::double END AS rec, CASE WHEN coalesce(selected_retriever_id, 1) = 1 OR gain IS NULL THEN 0.0::double ELSE gain - 0.005::double * {COST} END AS mig, {COST} AS cost
      FROM pipeline_result JOIN (SELECT result_id, letter FROM scored WHERE is_truth) USING (result_id) LEFT JOIN kl USING (result_id))""",
    "hard_negatives": _with(SCORED, HARD) + "SELECT * FROM hard",
    "preference_loss": _with(SCORED, HARD) + "SELECT round(avg(-ln(1 / (1 + exp(-0.1::double * (ln(w.p) - ln(l.p)))))), 6) AS loss, count(*) AS n FROM scored l JOIN hard USING (result_id, letter) JOIN scored w ON w.result_id = l.result_id AND w.is_truth",
    "moving_average": _with(STEPS) + "SELECT rank, round(CASE WHEN n < 50 THEN reward ELSE a END, 6) AS average FROM (SELECT reward, row_number() OVER o AS rank, count(*) OVER () AS n, avg(reward) OVER (ORDER BY event_id ROWS 49 PRECEDING) AS a FROM steps WINDOW o AS (ORDER BY event_id)) WHERE n < 50 OR rank >= 50",
    "recent_performance": _with(STEPS) + "SELECT round(avg(success::int), 6) AS success_rate, round(avg(reward), 6) AS avg_reward, round(stddev_pop(reward), 6) AS std_reward FROM (SELECT * FROM steps ORDER BY event_id DESC LIMIT 100)",
    "metrics_summary": _with(STEPS) + "SELECT count(*) AS n, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS std, round(min(reward), 6) AS least, round(max(reward), 6) AS most, round(avg(success::int), 6) AS success_rate, arg_max(event_id, (round(reward, 9), -event_id)) AS best_episode FROM steps",
    "train_test_split": "SELECT side, count(*) AS rows, min(result_id) AS first_id, max(result_id) AS last_id FROM (SELECT result_id, CASE WHEN row_number() OVER (ORDER BY result_id) <= floor(count(*) OVER () * 0.9::double) THEN 'train' ELSE 'test' END AS side FROM pipeline_result) GROUP BY 1",
    "circular_batch": """WITH r AS (SELECT result_id, row_number() OVER (ORDER BY result_id) AS rank, count(*) OVER () AS n FROM pipeline_result)
      SELECT result_id FROM r WHERE rank > 2100 % n AND rank <= 2100 % n + 300 UNION ALL SELECT result_id FROM r WHERE 2100 % n + 300 > n AND rank <= 2100 % n + 300 - n""",
    "epoch_stats": _with(REW + ", " + SCORED) + """SELECT epoch, count(*) AS n, round(avg(overall), 6) AS avg_reward, round(avg((overall > -1)::int), 6) AS success_rate, round(avg(top::int), 6) AS top1, round(avg((top OR place <= 3)::int), 6) AS top3, round(avg((top OR place <= 5)::int), 6) AS top5 FROM (
      SELECT round(overall, 6) AS overall, ((row_number() OVER (ORDER BY r.result_id) - 1) // 100)::bigint AS epoch, coalesce(coalesce(predicted_option, 'A') = t.letter, false) AS top, coalesce(t.rank, 99) AS place
      FROM rew r JOIN pipeline_result p ON p.result_id = r.result_id LEFT JOIN (SELECT result_id, letter, rank FROM scored WHERE is_truth) t ON t.result_id = r.result_id) GROUP BY 1""",
    "gae_advantages": "WITH RECURSIVE " + STEPS + """, s AS (SELECT event_id, user_id, day, reward, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) AS k FROM steps),
      g AS (SELECT event_id, user_id, day, k, reward - 0.5::double AS a FROM s WHERE k = 1 UNION ALL SELECT s.event_id, s.user_id, s.day, s.k, s.reward + 0.99::double * 0.4::double - 0.5::double + 0.99::double * 0.95::double * g.a FROM g JOIN s ON s.user_id = g.user_id AND s.day = g.day AND s.k = g.k + 1)
      SELECT event_id, round(a + 1e-9::double, 6) AS advantage FROM g""",
    "td_advantage": _with(STEPS) + "SELECT event_id, round(t, 6) AS target, round(t - 0.5::double, 6) AS advantage FROM (SELECT event_id, reward + CASE WHEN success THEN 0.99::double * 0.4::double ELSE 0.0::double END AS t FROM steps)",
    "normalised_advantages": _with(STEPS) + "SELECT event_id, round(CASE WHEN sd > 1e-8 THEN (reward - m) / (sd + 1e-8) ELSE reward - m END, 5) AS z FROM steps, (SELECT avg(reward) AS m, stddev_samp(reward) AS sd FROM steps)",
    "ema_baseline": "WITH RECURSIVE " + STEPS + EMA + "SELECT event_type, arg_max(round(b + 1e-9::double, 6), k) AS baseline FROM e GROUP BY 1",
    "ema_series": "WITH RECURSIVE " + STEPS + EMA + "SELECT event_type, event_id, round(b + 1e-9::double, 6) AS baseline FROM e",
    "epsilon_schedule": "SELECT result_id, round(greatest(0.1::double, 0.5::double * pow(0.9995::double, row_number() OVER (ORDER BY result_id))), 6) AS epsilon FROM pipeline_result",
    "running_action_distribution": _with(ACT) + "SELECT result_id, " + ", ".join(f"round(CASE WHEN rank = 1 THEN 0.25::double ELSE (count(*) FILTER (action = {k}) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::double / (rank - 1) END, 6) AS p{k}" for k in range(1, 5)) + " FROM act",
    "exploration_bonus": _with(ACT) + "SELECT result_id, round(0.2::double / sqrt((row_number() OVER (PARTITION BY action ORDER BY rank) + 1)::double), 6) AS bonus FROM act",
    "conversation_satisfaction": f"""SELECT user_id, round(avg(CASE WHEN g > b THEN 0.8::double WHEN b > g THEN 0.2::double ELSE 0.5::double END), 6) AS satisfaction FROM (SELECT user_id, {HITS('q', prompts.POSITIVE)} AS g, {HITS('q', prompts.NEGATIVE)} AS b FROM (
      SELECT user_id, lower(coalesce(user_query, '')) AS q, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, result_id DESC) AS r FROM pipeline_result WHERE user_id IS NOT NULL) WHERE r <= 3) GROUP BY 1""",
    "query_state_vector": f"""SELECT result_id, length(q) AS length, len({WORDS.format(t='q')}) AS words, {ANY('lower(q)', ('recommend', 'suggest'))}::bigint AS asks, {ANY('lower(q)', ('movie', 'film'))}::bigint AS movie, {ANY('lower(q)', ('actor', 'director'))}::bigint AS person, round(h / 24.0::double, 6) AS hour
      FROM (SELECT result_id, coalesce(user_query, '') AS q, hour(created_at AT TIME ZONE 'UTC') AS h FROM pipeline_result)""",
}
