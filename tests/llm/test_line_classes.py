"""The classes that the line report gives."""

from quelora.llm import lines


def test_every_member_of_a_class_is_named(spark):
    base = "some longer line of text that takes part in the edit join"
    near = [base, base.replace("longer", "larger"), base.replace("longer", "lorger")]
    other, alone = "an exact line of more words", "one that stands alone here"
    rows = [(0, f"{near[0]}\n{other}"), (1, f"x\n{near[1]}\n{alone}"), (2, near[2]), (3, other), (4, "x"), (5, None), (5, None), (6, near[1]), (6, near[1])]
    found = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    ids = {(r["id"], c["no"]): c["class_id"] for r in found for c in r["classes"]}
    assert set(ids) == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0), (6, 0)}
    assert ids[1, 0] == ids[4, 0]
    assert ids[0, 0] == ids[1, 1] == ids[2, 0] == ids[6, 0] and ids[0, 1] == ids[3, 0]
    assert len(set(ids.values())) == 4
    assert {r["id"]: r["n_links"] for r in found} == {0: 2, 1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 2}
