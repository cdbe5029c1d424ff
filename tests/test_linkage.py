"""Titles are folded once for a look-up, not once for each condition of its join."""

from leafmill.operators.linkage import linked_titles


def test_titles_are_folded_before_the_join(table):
    wanted = table("item_id long, title string, duration_s long", (1, "How the mind works today", 3600), (2, "How the mind works today", 3600), (3, None, 60))
    found = table(
        "item_id long, rank int, title string, duration_s long",
        (1, 0, "A wholly other tale xyz", 3600), (1, 1, "How the minds work today", 3600), (2, 0, "today works mind the How", 3600), (3, 0, None, 60),
    )
    linked = linked_titles(wanted, found)
    assert "regexp_replace" not in linked._jdf.queryExecution().optimizedPlan().toString()
    # The second title has the same characters in another order: only the exact ratio tells it apart.
    assert [(r.item_id, r.rank) for r in linked.collect()] == [(1, 1)]
