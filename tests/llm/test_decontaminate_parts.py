"""Leaks that are parts of an item, edited copies of it, or contradict one of its slots."""

from __future__ import annotations

from nearfield.llm import decontaminate


def test_parts_and_edits(make_docs, spark, prose):
    whole = prose(60, 1)
    words = whole.split()
    two_numbers = "how many baskets does the old farmer keep if 3 stand in the barn and 5 stand in the house"
    named = f"{prose(25, 2)} Alice {prose(25, 3)} Alice {prose(10, 4)}"
    plain = prose(70, 5).split()

    def numbered(extra, first, last):
        """A number behind every fifth word, so that no window is without slots."""
        out = [first if i == 2 else last if i == 67 else w for i, w in enumerate(plain)]
        return " ".join(f"{w} {i + extra}" if i % 5 == 4 else w for i, w in enumerate(out))

    items = [(0, whole), (1, two_numbers), (2, named), (3, numbered(1000, "Alice", "Alice"))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")

    def about(text, seed):
        return f"{prose(40, seed)} {text} {prose(40, seed + 1)}"

    def cut(step):
        return " zzz ".join(" ".join(words[i : i + step]) for i in range(0, 60, step))

    rows = [
        (1, about(" ".join(words[20:33]), 10)),  # 13 tokens in a row
        (2, about(" ".join(words[20:32]), 20)),  # 12 only
        (3, about(cut(12), 30)),  # shifts of 5 windows each
        (4, about(two_numbers.replace("3", "4").replace("5", "4"), 40)),
        (5, about(named.replace("Alice", "Carol", 1), 50)),
        (6, about(numbered(5000, "Carol", "Alice"), 60)),  # other numbers, one name with two values
        (7, about("", 70)),
        (8, about(numbered(5000, "Carol", "Carol"), 80)),
        # Two parts too small alone, further apart than the item is long.
        (9, " ".join(words[:12]) + " " + prose(90, 90) + " " + " ".join(words[30:42])),
    ]
    docs = make_docs(rows)
    found = {
        (r["doc_id"], r["item_id"]): (r["matched"], r["windows"])
        for r in decontaminate.contaminated(docs, benchmark).collect()
    }
    assert set(found) == {(1, 0), (3, 0), (4, 1), (5, 2), (6, 3), (8, 3)}
    assert found[1, 0] == (6, 53) and found[3, 0] == (25, 53)
    assert found[8, 3][0] == found[8, 3][1]
    kept = decontaminate.without_benchmark(docs, benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 9]
