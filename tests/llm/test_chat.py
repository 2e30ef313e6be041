import itertools
import random
import re
from collections import defaultdict

import pytest

from panelspark.llm import chat as H

K = H.Costs()


def brute(roles, K=K):
    """Least cost over all role sequences and merges, by trying every one."""
    best = float("inf")
    for path in itertools.product(range(3), repeat=len(roles)):
        cost, state = 0, H.START
        for r, q in zip(roles, path, strict=True):
            cost += (0 if r == H.ROLES[q] else K.relabel) if r else K.name
            made = H._BETWEEN[state, q]
            moves = [K.merge] if state == q else []
            cost += min(moves + ([] if made is None else [K.insert * len(made)]), default=float("inf"))
            state = q
        best = min(best, cost + K.insert * len(H._BETWEEN[state, H.START]))
    return best


def legal(text):
    turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) == text
    roles = [r for r, _ in turns]
    body = roles[roles[:1] == ["system"] :]
    return body and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body)) and len(body) % 2 == 0


@pytest.mark.parametrize("parts", [1, 7, 23])
def test_against_brute_force(spark, parts):
    rng = random.Random(parts)
    names = ["user", "assistant", "system", "", "Tool", "USER "]
    rows = [(c, k, rng.choice(names) if rng.random() < 0.9 else None, f"t{c}.{k}") for c in range(60) for k in range(rng.randint(1, 6))]
    rows += [(None, None, "user", None), (None, 3, "assistant", "x"), (1000, 0, "user", "same"), (1000, 0, "user", "same")]
    rows += [(2000, k, rng.choice(names[:3]), "hot") for k in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(3)
        out = H.repair_roles(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(out) == len(rows)
    convs, given = defaultdict(list), defaultdict(list)
    for r in out:
        convs[r.conv_id].append(r)
    low = lambda x: (x is not None, x if x is not None else 0)
    for r in sorted(rows, key=lambda r: (low(r[1]), r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        given[r[0]].append(H._known(r[2]))
    for c, got in convs.items():
        got.sort(key=lambda r: (r.part, r.place))
        assert [(low(r.turn), r.role or "") for r in got] == sorted((low(r.turn), r.role or "") for r in got)
        assert legal("".join(r.fragment for r in got)), c
        want = brute(given[c]) if len(given[c]) < 7 else H.transfer(given[c], K)[H.START]
        assert sum(r.cost for r in got) == (want if len(given[c]) < 7 else min(want + H._end(K)))


def test_render_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "user", "again")], "conv_id long, turn long, role string, text string")
    out = H.repair_roles(df)
    assert H.render(out).first().rendered == "<|im_start|>user\nhi\nagain<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert H.repair_roles(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_any_costs(spark, seed):
    """What is rendered is what was chosen: counted from the labels, each conversation costs the least."""
    rng = random.Random(seed)
    costs = H.Costs(merge=9) if not seed else H.Costs(*(rng.randint(0, 9) for _ in range(4)))
    rows = [(c, k, rng.choice(["user", "user", "assistant", "system", "?"]), f"t{k}") for c in range(60) for k in range(rng.randint(1, 5))]
    convs = defaultdict(list)
    for r in H.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), costs).collect():
        convs[r.conv_id].append(r)
    for c, got in convs.items():
        got.sort(key=lambda r: (r.part, r.place))
        given = [H._known(x[2]) for x in rows if x[0] == c]
        paid = sum(costs.merge * ("merge" in r.action) + costs.insert * r.inserted + (0 if H._known(r.role) == r.new_role else costs.relabel if H._known(r.role) else costs.name) for r in got)
        assert paid == sum(r.cost for r in got) == brute(given, costs)
        text = "".join(r.fragment for r in got)
        assert legal(text) and text.count("<|im_start|>") == len(got) + sum(r.inserted - ("merge" in r.action) for r in got)
