"""Prompts, answers and their effect, with a made-up provider."""

from papyrion.operators import enrich

META = [("d", 0, "Sheet1", 9, 5, True, "flat", "")]
KEY = "doc_id string, sheet_idx int"


def provider():
    def answer(prompts):
        return ['Sure: {"name": " Orders ", "description": "All orders", "sql_indexable_override": false, "sql_indexable_reason": "nested"} done' for _ in prompts]

    return answer


def frames(spark, n):
    meta = spark.createDataFrame(META, f"{KEY}, name string, n_rows int, n_cols int, sql_indexable boolean, reason string, description string")
    groups = spark.createDataFrame([("d", 0, i, f"group_{i}", f"path {i}", True) for i in range(n)], f"{KEY}, ord int, chunk_id string, path string, top boolean")
    samples = spark.createDataFrame([("d", 0, ["R1|HEADER|1:a", "R2|TASK|1:b"])], f"{KEY}, samples array<string>")
    return meta, groups, samples


def test_prompt_tiers(spark):
    meta, groups, samples = frames(spark, 30)
    tiers = [enrich.prompts(meta, groups, samples, budget).first() for budget in (1500, 260, 150, 1)]
    assert [t["tier"] for t in tiers] == ["full", "top", "skeleton", "skip"]
    assert "R1|HEADER|1:a" in tiers[0]["prompt"] and "18 more" in tiers[0]["prompt"]


def test_answers_are_applied(spark):
    meta, groups, samples = frames(spark, 3)
    asked = enrich.prompts(meta, groups, samples)
    got = enrich.apply(meta, enrich.parse(enrich.ask(asked, provider()))).first()
    assert (got["name"], got["description"], got["sql_indexable"], got["reason"]) == ("Orders", "All orders", False, "LLM override: nested")
    same = enrich.apply(meta, enrich.parse(enrich.ask(asked))).first()
    assert tuple(same) == tuple(meta.first())


def test_map_reduce(spark):
    _, groups, _ = frames(spark, 61)
    assert enrich.map_reduce(groups, provider()).count() == 1
    assert enrich.map_reduce(groups.limit(60), provider()).count() == 0
