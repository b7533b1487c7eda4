import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import hashing, text, urls
from quillspark.operators import audit, dedup, dml, evaluate, experiments, leitner, milestones, planning, resources, selection, topics, validation
from quillspark.schemas import SPECS, schema
from quillspark.sources import readers


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Étudiant", "etudiant"), ("où", "ou"), ("œuf", "œuf"), ("français ?", "francais?"), ("français ?", "francais?"), ("français ?", "francais?"), ("été", "ete"), ("a  b", "a b"), ("\ta b ", "a b"), ("", "")],
)
def test_match_key(spark, raw, want):
    assert one(spark, text.match_key(F.col("t")), t=raw) == want


def test_similarity_and_accents(spark):
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="", b=" ") == 1.0
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="abcd", b="abxd") == 0.75
    assert one(spark, text.has_correct_accents(F.col("a"), F.col("b")), a=" Été  ici ?", b="été ici?") is True
    assert one(spark, text.has_correct_accents(F.col("a"), F.col("b")), a="ete", b="été") is False


def evaluated(spark, user, correct, variations=(), level="beginner"):
    df = spark.createDataFrame([(user, correct, list(variations), level)], "user_answer string, correct_answer string, variations array<string>, difficulty string")
    r = evaluate.evaluate_answers(df).first()
    return r.tier, r.is_correct, r.score, r.matched_index


def test_tiers(spark):
    assert evaluated(spark, " x ", "xyz") == ("empty_check", False, 0, None)
    assert evaluated(spark, None, "xyz") == ("empty_check", False, 0, None)
    assert evaluated(spark, "Où es-tu ?", "où es-tu?") == ("exact_match", True, 100, None)
    assert evaluated(spark, "ou es-tu", "où es-tu") == ("exact_match", True, 98, None)
    assert evaluated(spark, "une reponse", "autre", ["réponse", "une réponse"]) == ("variation", True, 96, 1)
    near = "abcdefghijklmnopqrstuvwxyz"
    assert evaluated(spark, near, "nothing", [near[:-1] + "!", near]) == ("variation", True, 94, 0)
    assert evaluated(spark, "abcdefghij", "abcdefghix") == ("fuzzy", True, 90, None)
    assert evaluated(spark, "abcdefghij", "abcdefghix", level="intermediate") == ("fuzzy", False, 90, None)
    assert evaluated(spark, "abcdefghij", "abcdefghix", level="advanced") == ("needs_semantic", None, None, None)
    assert evaluated(spark, "abcdefghij", "abcdefgxyz") == ("fuzzy", False, 70, None)
    assert evaluated(spark, "anything", None) == ("needs_semantic", None, None, None)


def test_semantic_verdicts_and_saved_results(spark):
    rows = spark.createDataFrame([(1, "needs_semantic", None, None), (2, "needs_semantic", None, None), (3, "fuzzy", True, 90)], "id int, tier string, is_correct boolean, score int")
    verdicts = spark.createDataFrame([(1, True, 88)], "id int, verdict_correct boolean, verdict_score int")
    got = {r.id: (r.is_correct, r.score) for r in evaluate.with_semantic_verdicts(rows, verdicts).collect()}
    assert got == {1: (True, 88), 2: (False, 50), 3: (True, 90)}
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, correct_answer string")
    answers = spark.createDataFrame([(1, "a"), (2, ""), (3, "x")], "id int, user_answer string")
    ev = spark.createDataFrame([(3, True, None)], "id int, is_correct boolean, score int")
    saved = {r.id: (r.user_answer, r.is_correct, r.score) for r in evaluate.saved_results(questions, answers, ev).collect()}
    assert saved == {1: ("a", True, 100), 2: (None, False, 0), 3: ("x", True, 100), 4: (None, False, 0)}
    assert [r.score for r in evaluate.choice_answers(spark.createDataFrame([("a", "a"), (None, "a")], "user_answer string, correct_answer string")).collect()] == [100, 0]


QUESTIONS = [
    ("multiple-choice", "q", "a", ["a", "b", "c"], "MCQ must have exactly 4 options"),
    ("multiple-choice", "q", "x", ["a", "b", "c", "d"], "MCQ correctAnswer not in options"),
    ("multiple-choice", "q", "a", ["a", "b", "b", "d"], "MCQ has duplicate options"),
    ("multiple-choice", "q", "a", None, "MCQ must have exactly 4 options"),
    ("true-false", "q", "Vrai", ["Vrai", "Non"], 'T/F options must be ["Vrai", "Faux"]'),
    ("true-false", "q", "Oui", ["Vrai", "Faux"], "T/F correctAnswer must be Vrai or Faux"),
    ("fill-in-blank", "no blank", "a", None, "Fill-in-blank must contain _____"),
    ("fill-in-blank", "a _____", "", None, "Fill-in-blank answer is empty"),
    ("fill-in-blank", "a _____ b _____", "aimes", None, "Fill-in-blank has 2 blanks but 1 comma-separated answer groups"),
    ("fill-in-blank", "a _____ b _____", "aimes, préfère", None, None),
    ("writing", "q", "abcd", None, "Writing answer too short (<5 chars)"),
    ("writing", "q ( Réponse : x)", "abcdef", None, "Explicit answer label in question text"),
    ("other", "q", "", None, None),
]


def test_structural_validation(spark):
    df = spark.createDataFrame([(i, *q[:4]) for i, q in enumerate(QUESTIONS)], "i int, type string, question string, correct_answer string, options array<string>")
    got = {r.i: r.reject_reason for r in validation.validate_structure(df).collect()}
    assert got == {i: q[4] for i, q in enumerate(QUESTIONS)}


def test_meta_filters(spark):
    served = validation.is_meta_served(F.col("q"), F.col("e"))
    assert one(spark, served, q="What is a GROWTH mindset?", e=None) and not one(spark, served, q="effort", e="in language success")
    made = validation.is_meta_generated(F.col("q"), F.col("e"))
    assert one(spark, made, q="effort", e="in language success") and one(spark, made, q="Who is Mme. Dupont?", e=None) and not one(spark, made, q="Le chat dort", e="")


def test_post_processing_counts_each_outcome(spark):
    rows = [(0, "writing", "Write a sentence about cats", "Le chat dort.", None, None), (1, "writing", "What did we learn in class?", "Le chat dort.", None, None), (2, "true-false", "x", "Vrai", None, ["Vrai", "Faux"]), (3, "writing", "short", "abc", None, None), (4, "writing", "Translate cat", "un chat ici", None, None)]
    df = spark.createDataFrame([(*r, "beginner", None) for r in rows], "position int, type string, question string, correct_answer string, explanation string, options array<string>, difficulty string, acceptable_variations array<string>")
    verdicts = spark.createDataFrame([(0, True, ["Le chat dort bien."], "advanced", "OK"), (4, False, None, None, "")], "position int, answer_valid boolean, acceptable_variations array<string>, suggested_difficulty string, notes string")
    good, counts = validation.post_process(df, verdicts, 5, only="writing")
    assert [(r.position, r.difficulty, r.acceptable_variations) for r in good.collect()] == [(0, "advanced", ["Le chat dort bien."])]
    assert {r.outcome: r["count"] for r in counts.collect()} == {"meta_filtered": 1, "type_drift": 1, "structural_reject": 1, "validation_reject": 1}


def test_writing_types(spark):
    cases = {"Conjugate and translate": "conjugation", "Turn this into a question": "question_formation", "Rewrite it": "sentence_building", "Say it in French": "translation", "Describe your day": "open_ended", "Write a question sentence": "question_formation"}
    for prompt, kind in cases.items():
        assert one(spark, text.infer_writing_type(F.col("p")), p=prompt) == kind


def test_quotas():
    practice = selection.mode_shares("practice")
    assert selection.quotas(practice, 10) == {"multiple-choice": 4, "true-false": 1, "fill-in-blank": 2, "writing": 3}
    assert selection.quotas(practice, 20) == {"multiple-choice": 7, "true-false": 3, "fill-in-blank": 4, "writing": 6}
    assert sum(selection.quotas(practice, 7).values()) == 7 and selection.mode_shares("nonsense") == practice


def test_selection_fills_up(spark):
    pool = spark.createDataFrame([(i, "writing" if i < 3 else "fill-in-blank") for i in range(30)], "id int, type string")
    got = selection.select_by_distribution(pool, selection.mode_shares("assessment"), 12, "s").collect()
    assert len({r.id for r in got}) == 12 and sum(r.how == "backfill" for r in got) == 3
    assert {(r.type, r.quota, r.available) for r in selection.shortages(pool, selection.mode_shares("assessment"), 12).collect()} == {("writing", 6, 3)}
    legacy = selection.legacy_split(pool, 10, "s").collect()
    assert len(legacy) == 10 and sum(r.type == "writing" for r in legacy) == 3


def test_weighted_draw_prefers_weight(spark):
    pool = spark.createDataFrame([(i, 5 if i == 0 else 1) for i in range(6)], "id int, weight int")
    first = [selection.weighted_shuffle(pool, str(seed)).where("position = 1").first().id for seed in range(60)]
    assert 18 <= first.count(0) <= 42  # expected half of them


def test_leitner_fold_and_rate_limit(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    answers = [True, True, True, False, True, True, True, True, True, True, True, True]
    df = spark.createDataFrame([(1, 1, i, t(i), a) for i, a in enumerate(answers)], "study_code_id bigint, question_id bigint, event_id bigint, attempted_at timestamp_ntz, is_correct boolean")
    r = leitner.leitner_state(df).first()
    assert (r.box, r.consecutive_correct) == (5, 0)
    hits = spark.createDataFrame([(1, i, t(s)) for i, s in enumerate([0, 10, 20, 59, 60, 61, 70])], "k bigint, event_id bigint, attempted_at timestamp_ntz")
    got = [x.allowed for x in leitner.rate_limit(hits, "k", 60, 2).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, False, True]


def test_accuracy_crossing(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 1), 6999, 10000), (1, 2, dt.datetime(2024, 1, 2), 90_000, 90_000)]
    got = {r.id: r.crossed for r in milestones.accuracy_crossings(spark.createDataFrame(rows, "study_code_id int, id int, quiz_date timestamp_ntz, correct bigint, total bigint")).collect()}
    assert got == {1: None, 2: 90}


RESPONSES = {
    '[{"answer_correct": false, "severity": "minor", "notes": "bad"}, {"severity": "odd"}]': [(False, "minor", "bad"), (True, "suggestion", "OK")],
    '{"results": [{"answer_correct": true}]}': [(True, "suggestion", "OK"), (True, "suggestion", "OK")],
    '{"questions": [{}, {"answer_correct": false, "severity": "critical"}]}': [(True, "suggestion", "OK"), (False, "critical", "OK")],
    '{"answer_correct": false}': [(False, "suggestion", "OK"), (True, "suggestion", "OK")],
    "no json": [(True, "suggestion", "PARSE_ERROR: no json"), (True, "suggestion", "PARSE_ERROR: no json")],
}


def test_response_parsing(spark):
    df = spark.createDataFrame([(i, [10 * i, 10 * i + 1], r) for i, r in enumerate(RESPONSES)], "batch int, ids array<int>, response string")
    got = {r.id: (r.answer_correct, r.severity, r.notes) for r in audit.parse_responses(df).collect()}
    assert got == {10 * i + k: v for i, want in enumerate(RESPONSES.values()) for k, v in enumerate(want)}


def test_remediation_keeps_order_and_duplicates(spark):
    q = spark.createDataFrame([(1, "pending", "beginner", ["b", "a", "b", "c"]), (2, "pending", "beginner", ["a"]), (3, "pending", "advanced", ["a"])], "id int, quality_status string, difficulty string, acceptable_variations array<string>")
    ok = {c: True for c in audit.GATE}
    rows = [(1, *ok.values(), "advanced", ["a", "z"], "OK"), (2, False, *list(ok.values())[1:], "advanced", ["a"], "OK"), (3, *ok.values(), "expert", [], "API_ERROR: x")]
    r = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} boolean" for c in audit.GATE) + ", suggested_difficulty string, invalid_variations array<string>, notes string")
    got = {x.id: tuple(x)[1:] for x in audit.apply_audit(q, r).collect()}
    assert got == {1: ("active", "advanced", ["b", "b", "c"]), 2: ("flagged", "beginner", ["a"]), 3: ("pending", "advanced", ["a"])}


@pytest.mark.parametrize(
    ("url", "kind", "provider", "video", "short"),
    [
        ("https://www.youtube.com/watch?v=abc_-1", "video", "youtube", "abc_-1", False),
        ("https://youtube.com/shorts/XYZ", "video", "youtube", "XYZ", True),
        ("https://youtu.be/q1", "video", "youtu", "q1", False),
        ("https://vimeo.com/12", "video", "vimeo", None, False),
        ("https://www.example.org/a", "article", "example.org", None, False),
        ("not a url", "article", "unknown", None, False),
    ],
)
def test_urls(spark, url, kind, provider, video, short):
    r = spark.createDataFrame([(url,)], "u string").select(urls.resource_type(F.col("u")), urls.provider(F.col("u")), urls.youtube_id(F.col("u")), urls.is_short(F.col("u"))).first()
    assert tuple(r) == (kind, provider, video, short)


def test_sections_and_resources(spark):
    filler = [f"line {i}" for i in range(9)]
    doc = ["# Unit", "intro https://intro.example/x.", "## Verbs ER", *filler, "see [a link](https://a.example/1), and https://a.example/1", "### Deeper", "https://b.example/2).", "## Food words", *filler, "https://c.example/3", "## Short", "https://d.example/4"]
    materials = spark.createDataFrame([("unit-1", "\n".join(doc))], "unit_id string, text string")
    wanted = spark.createDataFrame([("unit-1", "Verbs", []), ("unit-1", "Meals", ["food"]), ("unit-1", "Short", []), ("unit-1", "Nothing", ["foo"])], "unit_id string, topic string, aliases array<string>")
    titles = spark.createDataFrame([("unit-1", "The unit")], "id string, title string")
    got = {(r.topic, r.url, r.title) for r in resources.extract_resources(materials, wanted, titles).collect()}
    assert got == {
        ("Verbs", "https://a.example/1", "a link"), ("Verbs", "https://b.example/2", "Deeper"), ("Meals", "https://c.example/3", "Food words"),
        ("General", "https://intro.example/x", "Unit"), ("General", "https://d.example/4", "Short"),
    }
    sections = resources.topic_sections(resources.lines_of(materials), wanted).groupBy("topic").count().collect()
    assert {r.topic: r["count"] for r in sections} == {"Verbs": 13, "Meals": 11}


def test_topics(spark):
    have = spark.createDataFrame([("Verb: Avoir (to have)",), ("Numbers 1-20",), ("Food and drink words",)], "topic string")
    new = spark.createDataFrame([("Numbers 1-20",), ("Food and drink",), ("Weather",), ("Some drink words for Food",)], "topic string")
    verdicts = spark.createDataFrame([("Food and drink", "Food and drink words", "identical"), ("Some drink words for Food", "Food and drink words", "overlapping")], "left string, right string, similarity string")
    got = {r.topic: (r.action, r.target) for r in topics.reconcile(new, have, verdicts).collect()}
    assert got == {"Numbers 1-20": ("reuse", "Numbers 1-20"), "Food and drink": ("reuse", "Food and drink words"), "Weather": ("new", "Weather"), "Some drink words for Food": ("review", None)}
    assert one(spark, F.array_join(text.heading_keywords(F.col("h")), "|"), h="The Verbs & Être – for verbs, to") == "verbs|être"


def test_dml(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    patched = dml.patch(target, spark.createDataFrame([(2, None)], "id int, v string"), "id", ["v"]).orderBy("id").collect()
    assert [tuple(r) for r in patched] == [(1, "a", "x"), (2, None, "y")]
    assert sorted(r.id for r in dml.insert_ignore(target, spark.createDataFrame([(2, "q", "q"), (3, "r", "r"), (3, "r", "r")], "id int, v string, w string"), ["id"]).collect()) == [1, 2, 3]
    with pytest.raises(LookupError):
        dml.single(target, "id", 9)
    assert dml.single(target, "id", 9, optional=True).count() == 0 and dml.as_role(target, "anon").count() == 0
    tables = {
        "batches": spark.createDataFrame([("b1",), ("b2",)], "id string"),
        "questions": spark.createDataFrame([("q1", "b1"), ("q2", "b2")], "id string, batch_id string"),
        "question_results": spark.createDataFrame([("r1", "q1"), ("r2", "q2")], "id string, question_id string"),
        "leitner_state": spark.createDataFrame([("s", "q1"), ("s", "q2")], "study_code_id string, question_id string"),
    }
    left = dml.cascade_delete(tables, "batches", spark.createDataFrame([("b1",)], "id string"))
    assert {n: df.count() for n, df in left.items()} == {"batches": 1, "questions": 1, "question_results": 1, "leitner_state": 1}
    stay, tally = dml.bulk_delete(target.withColumnRenamed("v", "code"), spark.createDataFrame([("a",), ("zz",)], "code string"))
    assert stay.count() == 1 and tuple(tally.first()) == (2, 0)


def test_sets_and_hashes(spark):
    assert one(spark, hashing.djb2(F.col("t")), t="abc") == 193485963
    pool = F.array(*(F.lit(x) for x in "abcde"))
    start = one(spark, hashing.djb2(F.col("t")) % 5, t="Verbs")
    assert one(spark, hashing.rotated_picks(F.col("t"), pool), t="Verbs") == [("abcde" * 2)[start + i] for i in range(3)]
    both = dedup.twin_union(spark.createDataFrame([(1, "h")], "id int, content_hash string"), {"B": spark.createDataFrame([(2, "h")], "id int, content_hash string")})
    assert [tuple(r) for r in dedup.pairwise_overlap(both).collect()] == [("B", "control", 1)]
    assert one(spark, dedup.shared_words(F.split("a", " "), F.split("b", " ")), a="some long words", b="words of some kind") == ["some", "words"]


def test_sources(spark, tmp_path):
    pages = "\f".join(["a" * 40, " ", "b" * 50, "c" * 120, "d"])
    got = one(spark, readers.chunk_pages(F.col("t"), 100), t=pages)
    assert got == ["a" * 40 + "\n\n" + "b" * 50, "c" * 120, "d"]
    assert one(spark, readers.chunk_pages(F.col("t"), 100), t=" \f ") == [" \f "]
    (tmp_path / "Unit 2.md").write_text("# two")
    (tmp_path / "Unit 20.md").write_text("# twenty")
    files = readers.markdown(spark, str(tmp_path))
    assert [r.file.replace("%20", " ") for r in readers.find_unit_file(files.withColumn("file", F.replace("file", F.lit("%20"), F.lit(" "))), resources.unit_pattern("2")).collect()] == ["Unit 2.md"]
    students = spark.createDataFrame([("c1", None, 'say "hi"', 1, 3, 2, dt.datetime(2024, 1, 1, 12), None)], "code string, display_name string, admin_label string, total_quizzes int, total_questions int, correct_answers int, created_at timestamp, last_active_at timestamp")
    lines = [r.value for r in readers.csv_lines(students).collect()]
    assert lines[0] == "Study Code,Display Name,Admin Label,Total Quizzes,Total Questions,Correct Answers,Accuracy %,Last Active (PST),Created At (PST)" and lines[1] == '"c1","Anonymous","say "hi"","1","3","2","66.67","","Jan 1, 2024, 4:00 AM"'
    assert [r.value for r in readers.markdown_lines(students.select("code")).collect()] == ["| code |", "| --- |", "| c1 |"]
    assert readers.markdown_report("T", {"S": students.select("code")}) == "# T\n\n## S\n\n| code |\n| --- |\n| c1 |\n"
    (tmp_path / "rows.json").write_text('[{"id": "1", "word": "x"}, {"id": "2"}]')
    assert readers.json_rows(spark, str(tmp_path / "rows.json"), "units").count() == 2
    assert all(schema(n).fields for n in SPECS)


def test_texts(spark):
    assert one(spark, text.rescue_json(F.col("t")), t='x {"a": [1, 2,], } y') == '{"a": [1, 2] }'
    assert one(spark, text.rescue_json(F.col("t")), t="none") is None
    assert one(spark, text.clean_conversion(F.col("t")), t="```markdown\nHere's the text:\n\n# T\nbody\n---\nPerfect for class\n```") == "# T\nbody\n---"
    assert one(spark, text.slug(F.col("u"), F.col("t"), F.lit("beginner"), F.lit(2)), u="unit-1", t="a  b") == "unit-1_a_b_beginner_q2"
    assert one(spark, text.lettered_options(F.split("o", ",")), o="x,y") == "A) x | B) y"
    assert one(spark, text.unit_label(F.col("u")), u="fill-in-blank") == "Fill In Blank"
    assert one(spark, text.normalize_topic(F.col("t")), t=" L’Été  (x) ") == "l'été x"


def test_experiments_and_plans(spark):
    rows = spark.createDataFrame([("control", 0.5, 0.2), ("B", 0.5, 0.1), ("C", 0.4, 0.1)], "cohort string, gate_pass_rate double, difficulty_mismatch_rate double")
    tied = {r.verdict for r in experiments.conclusions(rows, "gate_pass_rate").collect()}
    better = experiments.conclusions(rows, "difficulty_mismatch_rate").collect()
    assert tied == {"refuted"} and {r.verdict for r in better} == {"supported"} and {r.best_cohort for r in better} == {"B"}
    assert {r.verdict for r in experiments.conclusions(rows, "unknown").collect()} == {"refuted"}
    plan = spark.createDataFrame([("t", "beginner", 5), ("t", "advanced", 5)], "topic string, difficulty string, n int")
    assert sorted((r.difficulty, r["count"]) for r in planning.hybrid_passes(plan).collect()) == [("advanced", 5), ("beginner", 3), ("beginner", 3)]
    assert spark.range(1).select(planning.batch_record(F.lit(9), F.lit(2), F.lit(3))).first()[0] == -1
    stats = planning.generation_stats(spark.createDataFrame([(0, 0, 0, 0, 0)], "generated int, duplicates int, structural_rejects int, validation_rejects int, meta_filtered int")).first()
    assert stats.pass_rate == 100.0 and stats.collision_band == "none"
