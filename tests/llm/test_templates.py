"""Several templates in one leaf of the log-template tree, each with a variable field of its own."""

from test_ops import table

from runlake.llm import lines


def test_every_template_of_a_leaf_is_found(spark):
    names = ("alice", "bertha", "carl", "dora", "emil")
    a = [f"The user account of {n} was closed by the support team today" for n in names]
    b = [f"The user account needs a new password before the login of {n}" for n in names]
    c = ["The user account is written about once only in this whole corpus"]
    texts = [f"{x}\n{y}" for x, y in zip(a, b, strict=True)] + c
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(table(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "", 2: "", 3: "", 4: "", 5: c[0]}


def test_two_documents_are_not_enough(spark):
    texts = ["one line that two documents share here"] * 2 + ["another line of words"]
    assert lines.drop_recurring_lines(table(spark, texts)).where("n_dropped > 0").count() == 0
