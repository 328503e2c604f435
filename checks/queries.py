"""One query per operator, each over whole supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caseloom.functions.constants import MIN_INTENT_CONFIDENCE, MIN_SIMILARITY
from caseloom.functions.numbers import half_up
from caseloom.functions.text import clean_text, parse_created_at, strip
from caseloom.functions.vectors import norm, unit
from caseloom.operators import (
    ablation, approximate_search, brands, classifiers, cleaning, drafting, intents, metrics, policy, profile,
    retrieval, rubric, sparse_search, splits, sweeps, threads, tfidf, vector_index,
)
from caseloom.plans.decide import DecisionPlan, build_case_index
from caseloom.plans.evaluate import score_test_set, system_metrics, tune_thresholds
from caseloom.plans import train as training
from caseloom.plans.prepare import prepare
from caseloom.session import checkpoint_dir, cut_lineage
from caseloom.sources import readers, writers
from caseloom.streaming.decisions import decide_requests, start_decision_stream
from caseloom.streaming.monitor import escalation_windows, first_requests, start_monitor
from checks.views import messages, predicted_messages, raw_tweets, table

# The supplied conversations are few, so every brand counts.
SMALL_BRANDS = 1

# A taxonomy of words that occur in the supplied texts, one entry per language.
LANGUAGE_RULES = {
    "ENGLISH": [r"\bthe\b", r"\bof\b", r"\bthat\b", r"\band\b", r"\bwith\b"],
    "FRENCH": [r"\ble\b", r"\bla\b", r"\bque\b", r"\bdans\b", r"\bdes?\b"],
    "GERMAN": [r"\bder\b", r"\bund\b", r"\bnicht\b", r"\bdie\b", r"\bmit\b"],
    "SPANISH": [r"\bel\b", r"\blos?\b", r"\bpor\b", r"\bpara\b", r"\buna?\b"],
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- profile and cleaning --------------------------------------------------------------------


def profile_document_lengths(spark, d):
    return profile.text_lengths(table(spark, d, "documents"))


def clean_rows(spark, d):
    return cleaning.clean_tweets(raw_tweets(spark, d))


def clean_document_text(spark, d):
    text = clean_text(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.length(text).cast("bigint").alias("clean_length"), F.md5(text).alias("clean_md5")
    )


# --- threads ------------------------------------------------------------------------------------


def _nodes(spark, d):
    return threads.message_nodes(clean_rows(spark, d))


def _turns(spark, d):
    return threads.thread_turns(clean_rows(spark, d))


def conversations(spark, d):
    return threads.summarise_threads(_turns(spark, d))


def conv_roots(spark, d):
    return threads.find_roots(_nodes(spark, d))


def conv_edges(spark, d):
    return threads.reply_edges(_nodes(spark, d))


def conv_labels(spark, d):
    turns = _turns(spark, d)
    return turns.select("tweet_id", "conversation_id", "depth")


def conv_positions(spark, d):
    turns = cut_lineage(_turns(spark, d))
    return threads.turn_positions(turns).select("conversation_id", "position", "tweet_id", "inbound")


def conv_history(spark, d):
    pages = threads.history_pages(cut_lineage(_turns(spark, d)))
    lines = F.transform(
        "conversation_history", lambda t: F.concat(t["tweet_id"], F.lit("|"), t["author_id"], F.lit("|"), t["text"])
    )
    return pages.select(
        "conversation_id", "page", F.size("conversation_history").cast("bigint").alias("turns"),
        F.array_join(lines, " ~ ").alias("history"),
    )


# --- brands ---------------------------------------------------------------------------------------


def brand_counts(spark, d):
    return brands.brand_counts(conversations(spark, d))


def brand_vocabulary(spark, d):
    return brands.brand_vocabulary(conversations(spark, d))


def brand_ranking(spark, d):
    table_ = cut_lineage(brands.brand_table(cut_lineage(conversations(spark, d)), SMALL_BRANDS))
    ranked = brands.rank_brands(brands.brand_scores(table_))
    scores = ["score_vol", "score_multi", "score_vocab", "score_res", "composite_score"]
    return ranked.withColumns({c: half_up(F.col(c), 4) for c in scores})


def brand_best_conversations(spark, d):
    convs = cut_lineage(conversations(spark, d))
    scores = brands.brand_scores(cut_lineage(brands.brand_table(convs, SMALL_BRANDS)))
    return brands.of_best_brand(convs, scores).select("conversation_id", "brand", "turns")


# --- intents ---------------------------------------------------------------------------------------


def _labelled(spark, d):
    return intents.label_intents(messages(spark, d), "message")


def intent_hits(spark, d):
    return intents.hit_table(messages(spark, d), "message_id", "message")


def intent_labels(spark, d):
    return _labelled(spark, d).select("message_id", "intent", "intent_confidence")


def intent_counts(spark, d):
    return intents.intent_counts(_labelled(spark, d))


def intent_examples(spark, d):
    return intents.representative_examples(_labelled(spark, d), "message_id", "message")


def intent_taxonomy(spark, d):
    rows = intents.taxonomy_table(_labelled(spark, d), "message_id", "message")
    return rows.withColumn("representative_examples", F.array_join("representative_examples", " ~ "))


def intent_distribution(spark, d):
    return intents.intent_distribution(_labelled(spark, d))


def intent_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return intents.label_intents(docs, "text", LANGUAGE_RULES).select("doc_id", "intent", "intent_confidence")


def intent_conversations(spark, d):
    convs = intents.label_intents(conversations(spark, d))
    return convs.select("conversation_id", "brand", "intent", "intent_confidence")


# --- splits -------------------------------------------------------------------------------------------


def _document_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return splits.random_split(docs, "doc_id")


def split_random(spark, d):
    return _document_split(spark, d).select("doc_id", "split")


def split_sizes(spark, d):
    return splits.split_sizes(_document_split(spark, d))


def split_bucket(spark, d):
    return splits.split_sizes(splits.bucket_split(table(spark, d, "documents").select("doc_id"), "doc_id"))


def split_temporal(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    return splits.temporal_split(events, "event_id", F.col("ts")).select("event_id", "is_temporal_test")


def split_temporal_tweets(spark, d):
    rows = clean_rows(spark, d).select("tweet_id", "created_at")
    timed = splits.temporal_split(rows, "tweet_id", parse_created_at(F.col("created_at")))
    return timed.select("tweet_id", "is_temporal_test")


def leak_audit(spark, d):
    return splits.leakage_audit(_document_split(spark, d), ["doc_id", "text", "source"])


def leak_audit_temporal(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    split = splits.temporal_split(splits.random_split(events, "event_id"), "event_id", F.col("ts"))
    return splits.leakage_audit(cut_lineage(split), ["event_id", "user_id"], temporal=True)


def leak_index(spark, d):
    split = _document_split(spark, d)
    return splits.index_audit(split.where(F.col("split") == "train"), split, "doc_id")


# --- features ---------------------------------------------------------------------------------------------


def _document_model(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    counts = tfidf.term_counts(docs, "doc_id")
    n = docs.agg(F.count("*").alias("n")).scalar()
    return counts, tfidf.vocabulary(counts, n)


def tfidf_vocabulary(spark, d):
    _, vocab = _document_model(spark, d)
    return vocab.withColumn("idf", half_up(F.col("idf"), 6))


def _per_document(weighted, key):
    best = F.min_by("term", F.struct((-half_up(F.col("weight"), 6)).alias("w"), F.col("term")))
    return weighted.groupBy(key).agg(
        F.count("*").alias("n_known_terms"),
        half_up(F.sum("weight"), 5).alias("weight_sum"),
        half_up(F.max("weight"), 5).alias("weight_max"),
        best.alias("top_term"),
    )


def tfidf_documents(spark, d):
    counts, vocab = _document_model(spark, d)
    return _per_document(tfidf.weights(counts, vocab, "doc_id"), "doc_id")


def tfidf_turns_plain(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), "text")
    counts = tfidf.term_counts(turns, "turn_id", bigrams=False)
    vocab = tfidf.vocabulary(counts, turns.agg(F.count("*").alias("n")).scalar(), max_features=30_000)
    return _per_document(tfidf.weights(counts, vocab, "turn_id", sublinear=False), "turn_id")


def cosine_neighbour_turns(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = turns.join(after, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), F.array("text", "next_text").alias("texts")
    )
    return pairs.select("turn_id", rubric.pair_similarity(F.col("texts")).alias("similarity"))


def dense_unit(spark, d):
    v = F.posexplode(unit(F.col("embedding"))).alias("pos", "value")
    return table(spark, d, "embeddings").select("vec_id", v).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), half_up(F.col("value"), 6).alias("value")
    )


def _corpus(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("conversation_id"),
        F.col("text").alias("customer_message"),
        F.col("source").alias("brand_response"),
        F.col("lang").alias("intent"),
        F.lit("docs").alias("brand"),
        F.lit(1).cast("bigint").alias("turns"),
        F.lit("Tue Oct 31 22:10:47 +0000 2017").alias("timestamp"),
    )


def lsa_embedding(spark, d):
    index = build_case_index(_corpus(spark, d))
    return index.cases.select("conversation_id", "intent", "n_known_terms", half_up(norm(F.col("embedding")), 4).alias("length"))


def case_index_search(spark, d):
    index = build_case_index(_corpus(spark, d))
    asked = table(spark, d, "benchmark").select("item_id", "text")
    asked = cut_lineage(index.model.embed(asked, "item_id", "text"))
    found = retrieval.nearest_cases(asked, index.cases, "item_id", "conversation_id", 5)
    return found.select("item_id", "rank", "case_id", "similarity_score")


# --- classifiers and metrics --------------------------------------------------------------------------------


def _message_split(spark, d):
    rows = predicted_messages(spark, d).select("message_id", "message", "true_intent", "intent")
    return splits.random_split(rows, "message_id")


def cls_majority(spark, d):
    rows = _message_split(spark, d)
    train = rows.where(F.col("split") == "train")
    asked = rows.where(F.col("split") == "test").select("message_id")
    return classifiers.predict_majority(train, asked, "true_intent").select(
        "message_id", "predicted_intent", half_up(F.col("confidence"), 6).alias("confidence"), "is_uncertain"
    )


def cls_rules(spark, d):
    return classifiers.predict_by_rules(messages(spark, d), "message").select(
        "message_id", "predicted_intent", "raw_intent", "confidence", "is_uncertain"
    )


def cls_rules_uncertain(spark, d):
    return classifiers.predict_by_rules(messages(spark, d), "message", threshold=0.55).select(
        "message_id", "predicted_intent", "raw_intent", "confidence", "is_uncertain"
    )


def cls_rules_probabilities(spark, d):
    rows = classifiers.predict_by_rules(messages(spark, d), "message")
    return rows.select("message_id", F.explode_outer("all_probabilities").alias("intent", "probability")).where(
        F.col("probability") > 0
    )


def _centroid_predictions(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    return classifiers.predict_by_centroid(vectors, classifiers.class_centroids(vectors, "label"))


def cls_centroid(spark, d):
    return _centroid_predictions(spark, d).select(
        "vec_id", "predicted_intent", "raw_intent", "confidence", "is_uncertain"
    )


def cls_centroid_probabilities(spark, d):
    return _centroid_predictions(spark, d).select(
        "vec_id", F.explode_outer("all_probabilities").alias("label", "probability")
    )


def _fitted_metrics(spark, d, embedding):
    rows = cut_lineage(_message_split(spark, d))
    train = rows.where(F.col("split") == "train")
    model = classifiers.fit_intent_model(
        train, "message_id", "message", "intent", embedding=embedding
    )
    scored = model.predict(rows.where(F.col("split") == "test"), "message_id", "message")
    return metrics.evaluate(scored, "intent", "predicted_intent")


def cls_logistic(spark, d):
    return _fitted_metrics(spark, d, False)


def cls_lsa_logistic(spark, d):
    return _fitted_metrics(spark, d, True)


def _judged(spark, d):
    rows = messages(spark, d).select("message_id", "message", "true_intent")
    return metrics.confusion_counts(
        classifiers.predict_by_rules(rows, "message"), "true_intent", "predicted_intent"
    )


def metrics_overall(spark, d):
    return metrics.overall_scores(metrics.class_scores(_judged(spark, d)))


def metrics_per_class(spark, d):
    return metrics.per_class_table(metrics.class_scores(_judged(spark, d)))


def confusion_long(spark, d):
    return _judged(spark, d)


def confusion_wide(spark, d):
    counts = metrics.confusion_counts(_centroid_predictions(spark, d), "label", "raw_intent")
    classes = [str(i) for i in range(10)]
    wide = metrics.confusion_matrix(counts, classes)
    return wide.select(F.col("truth"), *[F.col(c).alias(f"p{c}") for c in classes])


def most_confused(spark, d):
    return metrics.most_confused(_judged(spark, d))


def metrics_quality_labels(spark, d):
    rows = table(spark, d, "labels").select("quality", (1 - F.col("toxic")).alias("guess"))
    return metrics.evaluate(rows, "quality", "guess")


def _comparison(spark, d):
    rows = cut_lineage(_message_split(spark, d))
    train = rows.where(F.col("split") == "train")
    held = {s: rows.where(F.col("split") == s).select("message_id", "message", "true_intent") for s in ("val", "test")}
    return metrics.compare_models(
        {
            "majority": lambda df: classifiers.predict_majority(train, df, "true_intent"),
            "rules": lambda df: classifiers.predict_by_rules(df, "message"),
            "labeller": lambda df: intents.label_intents(df, "message").withColumnRenamed("intent", "predicted_intent"),
        },
        held,
        "true_intent",
    )


def model_comparison(spark, d):
    return _comparison(spark, d)


def model_best(spark, d):
    return metrics.best_model(cut_lineage(_comparison(spark, d)))


def model_improvements(spark, d):
    comparison = cut_lineage(_comparison(spark, d))
    return metrics.improvements(comparison, metrics.best_model(comparison))


def _training_rows(spark, d):
    """Messages with their noisy true intent and split, written down."""
    rows = predicted_messages(spark, d).select("message_id", "message", F.col("true_intent").alias("intent"))
    return cut_lineage(splits.random_split(rows, "message_id"))


def model_trained(spark, d):
    """All five models on validation and test, and the model that validation chooses."""
    rows = _training_rows(spark, d)
    models = training.train_models(rows.where("split = 'train'"), "message_id", "message")
    held = {s: rows.where(F.col("split") == s).drop("split") for s in ("val", "test")}
    comparison = training.compare(models, held, "message_id", "message")
    chosen, _ = training.choose(models, comparison)
    return comparison.withColumn("chosen", F.col("model") == chosen)


def cls_stored(spark, d):
    """Test messages scored by centroids of texts that were stored and loaded again."""
    rows, path = _training_rows(spark, d), scratch(spark, "classifier")
    fitted = classifiers.fit_centroid_model(rows.where("split = 'train'"), "message_id", "message")
    training.save_model(spark, "centroid", fitted, path)
    _, model = training.load_model(spark, path)
    asked = rows.where("split = 'test'").select("message_id", "message")
    return model.predict(asked, "message_id", "message").select("message_id", "predicted_intent", "raw_intent")


# --- retrieval --------------------------------------------------------------------------------------------------


def _neighbours(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest_cases(vectors, vectors, "vec_id", "vec_id", 5, exclude_self=True)


def dense_topk(spark, d):
    return _neighbours(spark, d).withColumnRenamed("case_id", "neighbour_id")


def _asked_vectors(spark, d):
    """The stated query set: every vector whose id is divisible by 50, against all vectors."""
    return table(spark, d, "embeddings").select("vec_id", "embedding").where("vec_id % 50 = 0")


def _stored_neighbours(spark, d):
    """Neighbours from an index that is built in two parts."""
    vectors, path = table(spark, d, "embeddings").select("vec_id", "embedding"), scratch(spark, "vectors")
    vector_index.add_cases(spark, path, vectors.where("vec_id % 3 <> 0"), "vec_id")
    vector_index.add_cases(spark, path, vectors.where("vec_id % 3 = 0"), "vec_id")
    index = vector_index.open_index(spark, path)
    return vector_index.search(_asked_vectors(spark, d), index, "vec_id", "bigint", 5, exclude_self=True)


def stored_topk(spark, d):
    return _stored_neighbours(spark, d).withColumnRenamed("case_id", "neighbour_id")


def approx_topk(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = approximate_search.approximate_cases(_asked_vectors(spark, d), vectors, "vec_id", "vec_id", 5, exclude_self=True)
    return found.withColumnRenamed("case_id", "neighbour_id")


def approx_recall(spark, d):
    """Does the approximate search find nine of ten of the exact neighbours?"""
    found = approx_topk(spark, d).withColumnRenamed("neighbour_id", "case_id")
    row = approximate_search.recall(found, _stored_neighbours(spark, d), "vec_id")
    return row.select("queries", "expected", (F.col("recall") >= 0.9).alias("enough"))


def sparse_topk(spark, d):
    """The documents most like each benchmark item, by the weights of their words."""
    index = sparse_search.build_term_index(table(spark, d, "documents"), "doc_id")
    found = sparse_search.sparse_topk(table(spark, d, "benchmark"), index, "item_id")
    return found.withColumnRenamed("case_id", "doc_id")


def _judged_neighbours(spark, d):
    vectors = table(spark, d, "embeddings")
    stored = vectors.select(F.col("vec_id").alias("case_id"), F.col("label").alias("intent"))
    detailed = retrieval.with_case_details(_neighbours(spark, d), stored, "vec_id", "case_id")
    truth = vectors.select("vec_id", F.col("label").alias("true_intent"))
    return retrieval.judge_hits(detailed.join(truth, "vec_id"), "vec_id")


def retrieval_hits(spark, d):
    return _judged_neighbours(spark, d).withColumn("first_hit", F.coalesce("first_hit", F.lit(0)))


def retrieval_metrics(spark, d):
    return retrieval.retrieval_metrics(_judged_neighbours(spark, d))


def retrieval_examples(spark, d):
    return retrieval.hit_and_miss_examples(_judged_neighbours(spark, d), "vec_id").select(
        "vec_id", "hit_1", F.coalesce("first_hit", F.lit(0)).alias("first_hit"), "example"
    )


def retrieval_best_case(spark, d):
    """Each held-out vector against the training vectors, with the stored fields of the case."""
    vectors = splits.random_split(table(spark, d, "embeddings").select("vec_id", "embedding", "label"), "vec_id")
    vectors = cut_lineage(vectors)
    index = vectors.where(F.col("split") == "train").select(
        F.col("vec_id").alias("stored_id"), "embedding", F.col("label").alias("stored_label")
    )
    asked = vectors.where(F.col("split") != "train").select("vec_id", "embedding")
    found = retrieval.nearest_cases(asked, index, "vec_id", "stored_id", 1)
    return retrieval.with_case_details(found, index, "vec_id", "stored_id").select(
        "vec_id", "case_id", "similarity_score", "stored_label"
    )


def index_status(spark, d):
    return retrieval.index_status(table(spark, d, "embeddings"), MIN_INTENT_CONFIDENCE, MIN_SIMILARITY)


# --- policy and decisions ------------------------------------------------------------------------------------------


def _decided(spark, d):
    return policy.escalate(predicted_messages(spark, d))


def policy_decisions(spark, d):
    return _decided(spark, d).select("message_id", "rule_id", "escalate", "escalation_reason")


def policy_reason_counts(spark, d):
    return sweeps.reason_counts(_decided(spark, d))


def policy_rule_shares(spark, d):
    return sweeps.rule_shares(_decided(spark, d))


def policy_metrics(spark, d):
    return sweeps.policy_metrics(_decided(spark, d))


def trust_checks(spark, d):
    rows = policy.trust_checks(predicted_messages(spark, d))
    return rows.select("message_id", F.inline_outer("trust_checks"))


def _records(spark, d):
    checked = policy.trust_checks(_decided(spark, d))
    return policy.decide(drafting.draft_from_template(checked))


def decision_records(spark, d):
    return _records(spark, d).select(
        "message_id", "decision", "pipeline_stage", "draft_reply",
        F.array_join("evidence", " ~ ").alias("evidence"), "escalation_reason", "top_similarity",
    )


def decision_responses(spark, d):
    shaped = policy.shape_response(_records(spark, d), "message_id")
    cases = F.transform(
        "retrieved_cases",
        lambda c: F.concat_ws("|", c["conversation_id"], c["customer_message"], c["brand_response"], c["intent"],
                              c["rank"].cast("string"), F.format_string("%.4f", c["similarity_score"])),
    )
    passed = F.size(F.filter("trust_checks", lambda t: t["passed"]))
    return shaped.select(
        "message_id", "decision", "escalation_reason", "intent", "intent_confidence", "top_similarity",
        F.array_join(cases, " ~ ").alias("retrieved_cases"), passed.cast("bigint").alias("passed_checks"),
        "pipeline_stage",
    )


def request_check(spark, d):
    requests = raw_tweets(spark, d).select("tweet_id", F.col("text").alias("message"))
    valid, rejected = policy.split_requests(requests)
    return valid.select("tweet_id", "message", F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select("tweet_id", "message", "error")
    )


# --- sweeps ------------------------------------------------------------------------------------------------------------


def sweep_policy(spark, d):
    return sweeps.sweep_policy(predicted_messages(spark, d))


def _validation(spark, d):
    records = messages(spark, d).select(
        "message_id", F.col("true_intent").alias("intent"), "confidence", "top_similarity"
    )
    known = records.where(F.col("top_similarity") > 0)
    return sweeps.sweep_validation(
        records.drop("top_similarity"), known.select("message_id", "top_similarity"), "message_id"
    )


def sweep_validation(spark, d):
    return _validation(spark, d)


def sweep_safe_thresholds(spark, d):
    return sweeps.safe_thresholds(_validation(spark, d))


def target_check(spark, d):
    decided = cut_lineage(_decided(spark, d).select("message_id", "intent", "true_intent", "confidence", "escalate"))
    rows = sweeps.as_metric_rows(metrics.evaluate(decided, "true_intent", "intent"), {"macro_f1": "macro_f1"})
    rows = rows.unionByName(
        sweeps.as_metric_rows(sweeps.policy_metrics(decided), {"selective_accuracy_label": "selective_accuracy"})
    )
    return sweeps.against_targets(rows)


# --- drafting, rubric, ablation ----------------------------------------------------------------------------------------------


def _with_history(spark, d):
    turn = F.struct(F.lit(True).alias("inbound"), F.col("message").alias("text"))
    answer = F.struct(F.lit(False).alias("inbound"), F.col("true_reply").alias("text"))
    length = (F.col("message_id") % 4).cast("int")
    history = F.slice(F.array(turn, answer, turn, answer, turn, answer), F.lit(1), length * 2)
    rows = predicted_messages(spark, d).withColumn("history", history)
    return rows.withColumn("cases", F.slice("cases", F.lit(1), length))


def draft_prompts(spark, d):
    prompt = drafting.generation_prompt(*[F.col(c) for c in ("message", "intent", "confidence", "history", "cases")])
    bare = drafting.prompt_without_cases(F.col("message"), F.col("intent"), F.col("confidence"))
    return _with_history(spark, d).select(
        "message_id", F.length(prompt).cast("bigint").alias("prompt_length"), F.md5(prompt).alias("prompt_md5"),
        F.md5(bare).alias("bare_prompt_md5"),
    )


def draft_replies(spark, d):
    drafted = drafting.draft_from_template(_with_history(spark, d))
    return drafted.select(
        "message_id", drafting.customer_handle(F.col("message")).alias("handle"),
        F.array_join("evidence", " ~ ").alias("evidence"), "draft_reply",
    )


def draft_overrides(spark, d):
    """Replies that come as JSON from outside, some asking for a human."""
    n = F.col("message_id")
    reply = F.to_json(
        F.struct(
            F.when(n % 3 > 0, F.concat(F.lit("  "), F.col("true_reply"))).alias("draft_reply"),
            F.when(n % 4 == 0, F.lit(0.5)).alias("confidence"),
            (n % 6 == 0).alias("escalate"),
            F.when(n % 12 == 0, F.lit("needs a person")).alias("escalation_reason"),
        )
    )
    rows = _decided(spark, d).withColumn("raw_reply", reply)
    return policy.decide(drafting.read_generated(rows)).select(
        "message_id", "draft_reply", "confidence", "escalate", "escalation_reason", "pipeline_stage", "decision"
    )


def _replies(spark, d):
    return drafting.draft_from_template(predicted_messages(spark, d))


def _scored(spark, d):
    return rubric.score_replies(_replies(spark, d))


def quality_scores(spark, d):
    return _scored(spark, d).select(
        "message_id", *[F.col(s).cast("double").alias(s) for s in rubric.SCORES],
        F.array_join("unsupported_claims", " ~ ").alias("unsupported_claims"), "has_unsupported_claim",
    )


def quality_summary(spark, d):
    decided = policy.decide(drafting.draft_from_template(_decided(spark, d)))
    return rubric.quality_summary(rubric.score_replies(decided))


def quality_by_intent(spark, d):
    return rubric.quality_by_intent(_scored(spark, d))


def unsupported_claims(spark, d):
    tweets = clean_rows(spark, d).where(~F.col("inbound"))
    claims = rubric.unsupported_claims(F.col("cleaned_text"))
    return tweets.select("tweet_id", F.array_join(claims, " ~ ").alias("claims"), F.size(claims).cast("bigint").alias("n_claims"))


def quality_turn_text(spark, d):
    """Tone and words of the whole supplied turns."""
    turns = table(spark, d, "conversations")
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"),
        rubric.tone(F.col("text")).cast("bigint").alias("tone"),
        F.md5(strip(F.col("text"))).alias("text_md5"),
    )


def ablation_metrics(spark, d):
    return ablation.setting_metrics(ablation.all_settings(predicted_messages(spark, d), "message_id"))


def ablation_deltas(spark, d):
    return ablation.setting_deltas(ablation_metrics(spark, d))


# --- sources, plans, streaming -------------------------------------------------------------------------------------------------------


def source_csv(spark, d):
    """Write the messages as CSV, line breaks and quotes included, and read them back."""
    folder = scratch(spark, "csv")
    noted = raw_tweets(spark, d).withColumn("text", F.concat(F.col("text"), F.lit('\n"quoted", line ')))
    writer = noted.write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return readers.read_tweets_csv(spark, folder)


def source_json(spark, d):
    """Write labelled conversations as JSON lines and read the usable ones back."""
    folder = scratch(spark, "json")
    rows = intents.label_intents(conversations(spark, d)).withColumn(
        "conversation_history", F.lit(None).cast("array<struct<tweet_id:string>>")
    )
    writers.write_json_lines(rows.drop("conversation_history"), folder)
    read = readers.read_labelled_json(spark, folder, strict=True)
    return read.where(readers.has_text("customer_message", "brand_response")).drop("conversation_history", readers.CORRUPT)


def source_json_damaged(spark, d):
    """Records of the documents, some without an id and some cut off, written and read back."""
    folder = scratch(spark, "damaged")
    n = F.col("doc_id") % 10
    record = F.to_json(
        F.struct(
            F.when(n != 3, F.col("doc_id").cast("string")).alias("conversation_id"),
            F.col("text").alias("customer_message"), F.col("lang").alias("intent"),
        )
    )
    line = F.when(n == 7, F.substr(record, F.lit(1), F.length(record) - 5)).otherwise(record)
    table(spark, d, "documents").select(line.alias("value")).write.text(folder)
    read = readers.read_labelled_json(spark, folder)
    sound = F.col(readers.CORRUPT).isNull()
    return read.agg(
        F.count("*").alias("n_rows"), F.count_if(sound & F.col("conversation_id").isNull()).alias("n_without_id"),
        F.count_if(~sound).alias("n_corrupt"),
        F.coalesce(F.sum(F.when(sound, F.length("customer_message"))), F.lit(0)).alias("n_chars"),
    )


def index_cases(spark, d):
    """Cases worth indexing, of messages with tabs and line breaks at their ends."""
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        n.cast("string").alias("conversation_id"),
        F.when(n % 7 == 0, F.lit("\n\t ")).otherwise(F.concat(F.lit("\t"), "text", F.lit(" \n"))).alias("customer_message"),
        F.concat(F.lit("\n reply "), n.cast("string"), F.lit("\t")).alias("brand_response"),
        F.when(n % 3 != 0, F.col("lang")).alias("intent"), F.lit(None).cast("string").alias("brand"),
        F.lit(2).cast("bigint").alias("turns"), F.lit("").alias("timestamp"),
    )
    return retrieval.case_rows(rows).select(
        "conversation_id", F.length("customer_message").cast("bigint").alias("message_length"), "brand_response", "intent", "context"
    )


def source_head(spark, d):
    """The first 500 messages of a known intent in order: an evaluation sample."""
    rows = predicted_messages(spark, d).select("message_id", "message", "intent")
    return readers.head_rows(rows, 500, "message_id", readers.of_known_intent())


def plan_prepare(spark, d):
    return prepare(raw_tweets(spark, d), scratch(spark, "prepare"), SMALL_BRANDS)


def _plan(spark, d):
    convs = intents.label_intents(conversations(spark, d))
    split = cut_lineage(splits.random_split(convs, "conversation_id"))
    index = build_case_index(split.where(F.col("split") == "train"))
    plan = DecisionPlan(lambda df: classifiers.predict_by_rules(df, "message"), index)
    return plan, split


def plan_decide(spark, d):
    plan, _ = _plan(spark, d)
    asked = messages(spark, d).select("message_id", "message")
    return plan.run(asked, "message_id").select(
        "message_id", "intent", "confidence", "decision", "rule_id", "pipeline_stage", "draft_reply",
        "top_similarity", "n_known_terms",
    )


def plan_decide_rules(spark, d):
    """The part of all decisions that does not hang on similarities, and what holds for the rest."""
    rows = plan_decide(spark, d)
    early = F.col("rule_id").isin("ACTION", "TOO_SHORT", "AMBIGUOUS", "TAXONOMY", "CONFIDENCE")
    stopped = F.col("rule_id") != "NONE"
    return rows.select(
        "message_id", "intent", "confidence",
        F.when(early, F.col("rule_id")).alias("early_rule"),
        F.when(early, F.col("decision")).alias("early_decision"),
        F.when(early, F.col("pipeline_stage")).alias("early_stage"),
        (~stopped | (F.col("decision") == "ESCALATE")).alias("stopped_escalates"),
        ((F.col("draft_reply") == "") == stopped).alias("draft_unless_stopped"),
        F.col("top_similarity").between(0.0, 1.0).alias("similarity_in_range"),
    )


def plan_evaluate(spark, d):
    plan, split = _plan(spark, d)
    return system_metrics(score_test_set(plan, split.where(F.col("split") == "test")))


def plan_tune(spark, d):
    plan, split = _plan(spark, d)
    return tune_thresholds(split.where(F.col("split") == "val"), plan)


def stream_decisions(spark, d):
    """All messages as a stream of JSON files; decisions read back as a table."""
    plan, _ = _plan(spark, d)
    folder = scratch(spark, "stream")
    tweets = raw_tweets(spark, d).where(F.col("inbound"))
    tweets.select(
        F.col("text").alias("message"), F.expr("CAST(NULL AS ARRAY<STRUCT<author_id: STRING, text: STRING, inbound: BOOLEAN>>)")
        .alias("conversation_history"),
    ).repartition(2).write.option("ignoreNullFields", False).json(f"{folder}/in")
    stream = readers.read_requests(spark, f"{folder}/in", stream=True, files_per_trigger=1)
    query = start_decision_stream(
        stream, decide_requests(plan), f"{folder}/out", f"{folder}/rejected", f"{folder}/state"
    )
    query.awaitTermination()
    done = spark.read.parquet(f"{folder}/out").select("message", "decision", "pipeline_stage", "intent")
    bad = spark.read.parquet(f"{folder}/rejected").select("message", F.col("error").alias("decision"))
    return done.unionByName(bad, allowMissingColumns=True)


def stream_escalations(spark, d):
    """Escalations by day and rule from a stream with repeated and late requests.

    The requests arrive in four parts by time, one run of the stream each. Every seventh request comes again
    with the next part, every eleventh only with the next part: of these, those that the
    watermark has passed by then are left out.
    """
    folder = scratch(spark, "monitor")
    events = table(spark, d, "events").select(F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    micros = F.unix_micros("ts")
    ends = events.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    width = ((ends["b"] or 0) - (ends["a"] or 0)) // 4 + 1
    part = F.floor((micros - F.lit(ends["a"] or 0)) / F.lit(width)).cast("int")
    n = F.col("message_id")
    late = F.when(n % 11 == 0, 1).otherwise(0)
    turns = F.when(n % 7 == 0, F.array(part + late, part + 1)).otherwise(F.array(part + late))
    decided = policy.escalate(predicted_messages(spark, d)).select("message_id", "escalate", "rule_id")
    sent = decided.join(events.withColumn("turns", turns), "message_id").withColumn("turn", F.explode("turns"))
    columns = [F.col("message_id").cast("string").alias("request_id"), "ts", "escalate", "rule_id"]
    arriving = sent.select(*columns, "turn")
    # A folder for each part, which is then read alone.
    arriving.write.partitionBy("turn").parquet(f"{folder}/sent")
    arriving = spark.read.schema(arriving.schema).parquet(f"{folder}/sent")
    for turn in range(5):
        arriving.where(F.col("turn") == turn).drop("turn").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(arriving.drop("turn").schema).parquet(f"{folder}/in")
        counts = escalation_windows(first_requests(stream, "request_id", "ts", "2 days"), "ts", "1 day")
        start_monitor(counts, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/out").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rule_id", "requests", "escalated"
    )


def source_csv_head(spark, d):
    """The first 500 rows of several CSV files."""
    folder = scratch(spark, "csv-head")
    rows = raw_tweets(spark, d)
    sorted_ = rows.withColumn("text", F.concat(F.col("text"), F.lit('\n"quoted", line '))).orderBy(*rows.columns)
    writer = sorted_.write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return readers.read_tweets_head(spark, folder, 500)


def _profile(fn, *args):
    return lambda spark, d: fn(raw_tweets(spark, d), *args)


QUERIES = {
    "profile_shape": _profile(profile.table_shape),
    "profile_missing": _profile(profile.missing_values),
    "profile_duplicates": _profile(profile.duplicates),
    "profile_directions": _profile(profile.directions),
    "profile_top_brand_authors": _profile(profile.top_brand_authors),
    "profile_authors": _profile(profile.authors),
    "profile_authors_compat": _profile(profile.authors, True),
    "profile_text_lengths": _profile(profile.text_lengths),
    "profile_document_lengths": profile_document_lengths,
    "profile_date_range": _profile(profile.date_range),
    "profile_links": _profile(profile.link_counts),
    "clean_rows": clean_rows,
    "clean_counts": _profile(cleaning.clean_counts),
    "clean_document_text": clean_document_text,
    "conv_roots": conv_roots,
    "conv_edges": conv_edges,
    "conv_labels": conv_labels,
    "conv_positions": conv_positions,
    "conv_records": conversations,
    "conv_history": conv_history,
    "brand_counts": brand_counts,
    "brand_vocabulary": brand_vocabulary,
    "brand_ranking": brand_ranking,
    "brand_best_conversations": brand_best_conversations,
    "intent_hits": intent_hits,
    "intent_labels": intent_labels,
    "intent_counts": intent_counts,
    "intent_examples": intent_examples,
    "intent_taxonomy": intent_taxonomy,
    "intent_distribution": intent_distribution,
    "intent_documents": intent_documents,
    "intent_conversations": intent_conversations,
    "split_random": split_random,
    "split_sizes": split_sizes,
    "split_bucket": split_bucket,
    "split_temporal": split_temporal,
    "split_temporal_tweets": split_temporal_tweets,
    "leak_audit": leak_audit,
    "leak_audit_temporal": leak_audit_temporal,
    "leak_index": leak_index,
    "tfidf_vocabulary": tfidf_vocabulary,
    "tfidf_documents": tfidf_documents,
    "tfidf_turns_plain": tfidf_turns_plain,
    "cosine_neighbour_turns": cosine_neighbour_turns,
    "dense_unit": dense_unit,
    "lsa_embedding": lsa_embedding,
    "case_index_search": case_index_search,
    "cls_majority": cls_majority,
    "cls_rules": cls_rules,
    "cls_rules_uncertain": cls_rules_uncertain,
    "cls_rules_probabilities": cls_rules_probabilities,
    "cls_centroid": cls_centroid,
    "cls_centroid_probabilities": cls_centroid_probabilities,
    "cls_logistic": cls_logistic,
    "cls_lsa_logistic": cls_lsa_logistic,
    "metrics_overall": metrics_overall,
    "metrics_per_class": metrics_per_class,
    "metrics_quality_labels": metrics_quality_labels,
    "confusion_long": confusion_long,
    "confusion_wide": confusion_wide,
    "most_confused": most_confused,
    "model_comparison": model_comparison,
    "model_best": model_best,
    "model_improvements": model_improvements,
    "model_trained": model_trained,
    "cls_stored": cls_stored,
    "dense_topk": dense_topk,
    "retrieval_hits": retrieval_hits,
    "retrieval_metrics": retrieval_metrics,
    "retrieval_examples": retrieval_examples,
    "retrieval_best_case": retrieval_best_case,
    "index_status": index_status,
    "policy_decisions": policy_decisions,
    "policy_reason_counts": policy_reason_counts,
    "policy_rule_shares": policy_rule_shares,
    "policy_metrics": policy_metrics,
    "trust_checks": trust_checks,
    "decision_records": decision_records,
    "decision_responses": decision_responses,
    "request_check": request_check,
    "sweep_policy": sweep_policy,
    "sweep_validation": sweep_validation,
    "sweep_safe_thresholds": sweep_safe_thresholds,
    "target_check": target_check,
    "draft_prompts": draft_prompts,
    "draft_replies": draft_replies,
    "draft_overrides": draft_overrides,
    "quality_scores": quality_scores,
    "quality_summary": quality_summary,
    "quality_by_intent": quality_by_intent,
    "quality_turn_text": quality_turn_text,
    "unsupported_claims": unsupported_claims,
    "ablation_metrics": ablation_metrics,
    "ablation_deltas": ablation_deltas,
    "source_csv": source_csv,
    "source_json": source_json,
    "source_json_damaged": source_json_damaged,
    "index_cases": index_cases,
    "source_head": source_head,
    "plan_prepare": plan_prepare,
    "plan_decide": plan_decide,
    "plan_decide_rules": plan_decide_rules,
    "plan_evaluate": plan_evaluate,
    "plan_tune": plan_tune,
    "stream_decisions": stream_decisions,
    "stored_topk": stored_topk,
    "approx_topk": approx_topk,
    "approx_recall": approx_recall,
    "sparse_topk": sparse_topk,
    "stream_escalations": stream_escalations,
    "source_csv_head": source_csv_head,
}
