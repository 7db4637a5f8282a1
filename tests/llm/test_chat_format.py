from collections import defaultdict

import pytest

from tallyloom.llm import chat_format as C

ROWS = [
    (1, 0, "system", "rules", "z"), (1, 1, "ann", "hi é", "z"), (1, 2, "bob", None, "z"), (1, 3, None, "who", "z"), (1, 3, None, "who", "z"), (1, 4, "ann", "x" * 3000, "z"),
    (None, 0, "ann", "a", "z"), (None, None, "bob", "b", "z"), (2, 0, "system", "alone", "z"), (3, 1, "u", "", "z"), (3, 1, "a", "tie", "z"),
]
SCHEMA = "conv_id long, turn long, role string, text string, rendered string"


def plain(rows, max_turns=C.MAX_TURNS):
    talks = defaultdict(list)
    for c, t, r, x, *_ in rows:
        talks[c].append(((-1 if t is None else t), r or "unknown", x or ""))
    out = set()
    for c, turns in talks.items():
        turns.sort()
        for who in {r for _, r, _ in turns} - {"system"}:
            start = 0
            for part in range(-(-len(turns) // max_turns)):
                here = turns[part * max_turns : (part + 1) * max_turns]
                text, mask, n = "", [], 0
                for _, r, x in here:
                    text += "<|im_start|>" + ("system" if r == "system" else "assistant" if r == who else "user name=" + r) + "\n"
                    begin = len(text)
                    text += x + "<|im_end|>\n"
                    if r == who:
                        mask.append(f"{begin}:{len(text)}")
                        n += 1
                out.add((c, part, who, text, ",".join(mask), len(here), n, start))
                start += len(text)
    return out


@pytest.mark.parametrize("max_turns", [C.MAX_TURNS, 2, 1])
def test_equals_brute_force(spark, max_turns):
    """Short dialogues, and long ones in parts: turns with equal numbers, equal rows and null ids among them."""
    got = C.rotate(spark.createDataFrame(ROWS, SCHEMA).repartition(3), max_turns=max_turns)
    assert {tuple(r) for r in got.collect()} == plain(ROWS, max_turns) and got.count() == len(plain(ROWS, max_turns))


def test_turn_numbers_do_not_cut_a_dialogue(spark):
    rows = [(7, 1020 + i, "ab"[i % 2], f"t{i}", "") for i in range(10)]
    got = C.rotate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == plain(rows) and [r.part for r in got] == [0, 0]


def test_a_speaker_silent_in_a_part_gets_it_too(spark):
    rows = [(None, None if i < 5 else i, "guest" if i == 0 else "host", f"t{i}", "") for i in range(3000)]
    got = C.rotate(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == 6
    assert sum(r.n_turns for r in got if r.speaker == "guest") == 3000


def test_mask_is_the_speakers_content(spark):
    for r in C.rotate(spark.createDataFrame(ROWS, SCHEMA)).collect():
        for span in filter(None, r["mask"].split(",")):
            a, b = map(int, span.split(":"))
            assert r.rendered[:a].endswith("<|im_start|>assistant\n") and r.rendered[a:b].endswith("<|im_end|>\n")


def test_empty(spark):
    assert C.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
