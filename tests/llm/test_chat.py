"""Roles against one long Viterbi pass, and held-out accuracy."""

import random

import numpy as np

from cilens.llm import chat


def test_blocks_and_markers():
    assert chat.blocks("User: hi\nAssistant: hello\nmore") == [(2, "hi"), (3, "hello\nmore")]
    assert chat.blocks("### Human\nwhat\n<|assistant|>ok<|im_end|>") == [(2, "what"), (3, "ok")]
    assert chat.blocks("[12:30] **Bot**: yes\nQ: why") == [(3, "yes"), (2, "why")]
    assert chat.blocks("the user: no marker here") == [(0, "the user: no marker here")]
    assert chat.blocks("") == [(0, "")] and chat.blocks("intro\nUser: x")[0] == (0, "intro")


def value(model, codes, roles):
    return sum(model.step[a, b] + model.seen[c, b] for a, b, c in zip([len(chat.ROLES), *roles[:-1]], roles, codes, strict=True))


def test_segments_give_the_path_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)  # long conversations need several levels
    rng = random.Random(1)
    rows = []
    for conv in range(6):
        for turn in range(rng.choice([1, 2, 3, 10, 80, 400])):
            role = "user" if turn % 2 == 0 else "assistant"
            rows.append((conv, turn, role if rng.random() < 0.9 else "tool", "x " * rng.randrange(1, 40 if role == "user" else 300) + rng.choice(["", "?", "\nUser: again"])))
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    model = chat.Model([(1, chat.code(0, "x " * 20), 50), (2, chat.code(0, "x " * 200), 50)], [(4, 1, 5), (1, 2, 40), (2, 1, 40), (2, 3, 2), (3, 1, 2)])
    found = chat.parse(df, model=model).collect()
    for conv in range(6):
        codes = np.array([chat.code(*b) for _, _, _, t in sorted(r for r in rows if r[0] == conv) for b in chat.blocks(t)])
        want = model.path(codes, len(chat.ROLES), int(model.matrix(codes)[-1].argmax()))
        got = [chat.ROLES.index(r.role) for r in sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.position, r.block))]
        assert value(model, codes, got) == value(model, codes, want) == model.matrix(codes)[-1].max()


def test_roles_of_held_out_conversations(spark, folder):
    rows = chat.query(spark, folder).where("held_out and block = 0").collect()
    assert np.mean([r.role == r.given for r in rows]) >= 0.9


def test_odd_rows(spark):
    rows = [(1, 0, None, "User: hi\nAssistant: hello\nUser: bye?", 1), (None, None, "user", None, 1), (1, 2, "assistant", "", 1), (2, 0, "nobody", "same", 1), (2, 0, "nobody", "same", 1)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, position int")
    found = sorted(chat.parse(df).collect(), key=lambda r: (r.conv_id or 0, r.position, r.block))
    assert [(r.conv_id, r.turn, r.block, r.content) for r in found] == [
        (None, None, 0, ""), (1, 0, 0, "hi"), (1, 0, 1, "hello"), (1, 0, 2, "bye?"), (1, 2, 0, ""), (2, 0, 0, "same"), (2, 0, 0, "same")]
    assert [r.role for r in found[1:4]] == ["user", "assistant", "user"] and found[5].given is None
    assert found[1].rendered == "<|im_start|>user\nhi<|im_end|>\n"
    assert chat.parse(df.limit(0)).count() == 0 and chat.parse(df.drop("role")).count() == 7
