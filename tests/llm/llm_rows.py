"""Small documents with nulls, empty and long texts, repeats and clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, component_id string, _tokens int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: base.replace(" ", "\t\n", 7), 5: words(2, 80) + " " + " ".join(near[10:40]), 6: words(3, 40), 7: None, 8: "", 9: " \t", 10: "three short words",
        11: "Three  SHORT words", 12: words(4, 6000), 13: words(4, 6000) + " tail", 14: "é" * 30 + words(5, 30), 15: "é" * 30 + words(5, 30), 16: "12345 !!! 678", 17: words(6, 12) + " x" * 200,
    }
    return [(k, t, ["en", "fr", None][k % 3], f"s{k % 2}", len(t or ""), None, "clash", 3) for k, t in texts.items()]
