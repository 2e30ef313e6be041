"""Cheapest repair of role sequences in conversations, and their rendering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import _common as C

ROLES = ("system", "user", "assistant")
START = 3
#: Turns that may follow a state; a conversation ends after the assistant.
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}


@dataclass(frozen=True)
class Costs:
    merge: int = 1  # into the turn before, of the same role
    insert: int = 2  # an empty turn
    relabel: int = 3  # a known role
    name: int = 1  # a role that is missing or unknown


def _insertions(state: int, role: int) -> tuple[int, ...] | None:
    """Empty turns that lead from a state to a turn of `role` (START: the end), the fewest."""
    paths = [(state, ())]
    for _ in range(4):
        for s, made in paths:
            if (role == START and s == 2) or (role != START and role in LEGAL[s]):
                return made
        paths = [(q, (*made, q)) for s, made in paths for q in LEGAL[s] if q]
    return None


_BETWEEN = {(s, q): _insertions(s, q) for s in (0, 1, 2, START) for q in (0, 1, 2, START)}


def _merges(costs: Costs, state: int, role: int) -> bool:
    """Whether a turn of the state's own role is merged: where that costs no more than empty turns between the two."""
    return state == role and (_BETWEEN[state, role] is None or costs.merge <= costs.insert * len(_BETWEEN[state, role]))


def _steps(costs: Costs) -> dict[str, np.ndarray]:
    """For each observed role the cost of going from a state (rows) to the role it is given (columns)."""
    move = np.full((4, 3), np.inf)
    for s in range(4):
        for q in range(3):
            if _BETWEEN[s, q] is not None:
                move[s, q] = costs.insert * len(_BETWEEN[s, q])
            if _merges(costs, s, q):
                move[s, q] = costs.merge
    out = {r: move + np.array([0 if k == q else costs.relabel for q in range(3)]) for k, r in enumerate(ROLES)}
    out[""] = move + costs.name
    return out


def _end(costs: Costs) -> np.ndarray:
    return np.array([costs.insert * len(_BETWEEN[s, START]) for s in range(3)], float)


def transfer(roles: list[str], costs: Costs) -> np.ndarray:
    """Least cost from each state before the turns (rows) to each state after them (columns)."""
    steps = _steps(costs)
    best = steps[roles[0]].copy()
    for r in roles[1:]:
        best = (best[:, :, None] + steps[r][None, :3, :]).min(1)
    return best


def solve(roles: list[str], costs: Costs, entry: int = START, leave: int | None = None) -> list[int]:
    """Roles of the cheapest legal sequence, of equals that with the least role numbers from the end."""
    steps = _steps(costs)
    best, back = steps[roles[0]][entry], []
    for r in roles[1:]:
        through = best[:, None] + steps[r][:3]
        back.append(through.argmin(0))
        best = through.min(0)
    at = leave if leave is not None else int((best + _end(costs)).argmin())
    path = [at]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _empty(roles) -> str:
    return "".join(OPEN.format(ROLES[q]) + CLOSE for q in roles)


def _known(role) -> str:
    role = (role or "").strip().lower()
    return role if role in ROLES else ""


_OUT = "conv_id bigint, turn bigint, role string, new_role string, action string, inserted int, cost int, fragment string, part int, place int"


def _render(costs: Costs):
    def run(batches):
        move = _steps(costs)
        for t in C.runs_of(batches, "conv_id", "part"):
            rows = t.to_pylist()
            entry = rows[0]["entry"] if rows[0]["entry"] is not None else START
            last = rows[0]["leave"] is None or rows[0]["is_last"]
            roles = [_known(r["role"]) for r in rows]
            path = solve(roles, costs, entry, rows[0]["leave"])
            out, state = [], entry
            for k, (r, q) in enumerate(zip(rows, path, strict=True)):
                merged = _merges(costs, state, q)
                made = () if merged else _BETWEEN[state, q]
                text = r["text"] or ""
                fragment = "\n" + text if merged else (CLOSE if state != START else "") + _empty(made) + OPEN.format(ROLES[q]) + text
                cost = move[roles[k]][state, q]
                inserted = len(made)
                if last and k == len(rows) - 1:
                    after = _BETWEEN[q, START]
                    fragment += CLOSE + _empty(after)
                    inserted += len(after)
                    cost += costs.insert * len(after)
                action = "+".join([*(["relabel"] if roles[k] != ROLES[q] else []), *(["merge"] if merged else []), *(["insert"] if inserted else [])]) or "keep"
                out.append((r["conv_id"], r["turn"], r["role"], ROLES[q], action, inserted, int(cost), fragment, r["part"], k))
                state = q
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            names = [x.split()[0] for x in _OUT.split(", ")]
            for k in range(0, len(out), 4096):
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out[k : k + 4096], strict=True), kinds, strict=True)], names=names)

    return run


def _matrices(costs: Costs):
    def run(batches):
        for t in C.runs_of(batches, "conv_id", "part"):
            m = transfer([_known(r) for r in t.column("role").to_pylist()], costs)
            yield pa.record_batch([t.column("conv_id").slice(0, 1).combine_chunks(), t.column("part").slice(0, 1).combine_chunks(), pa.array([m.tobytes()], pa.binary())], names=["conv_id", "part", "matrix"])

    return run


def _boundaries(costs: Costs):
    """States before and after each part of a conversation that lies in several: one row for each part."""

    def run(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        mats = [np.frombuffer(r["matrix"]).reshape(4, 3) for r in rows]
        best, back = mats[0][START], []
        for m in mats[1:]:
            through = best[:, None] + m[:3]
            back.append(through.argmin(0))
            best = through.min(0)
        path = [int((best + _end(costs)).argmin())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        return pa.table({
            "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()),
            "part": pa.array([r["part"] for r in rows], pa.int32()),
            "entry": pa.array([START, *path[:-1]], pa.int32()),
            "leave": pa.array(path, pa.int32()),
            "is_last": pa.array([k == len(rows) - 1 for k in range(len(rows))]),
        })

    return run


def repair_roles(turns: DataFrame, costs: Costs = Costs(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn: conv_id, turn, role, new_role, action, inserted, cost, fragment, part, place.

    Legal conversations are an optional system turn, then user and assistant in turn, ending with the assistant. The
    cheapest repair relabels turns, merges a turn into the one before, or inserts empty turns. `fragment` is the turn's
    share of the rendered conversation: fragments in the order of (part, place) make it up.

    Turns are range-partitioned by (conversation, turn, role, text). A conversation in one partition is solved there.
    Of one that lies in several, each part is first reduced to a small matrix of least costs between states; these
    matrices, one for each part, tell the states at the cuts, and then every part is solved on its own. So a
    conversation with very many turns is never in one task.

    Defined results: a null conversation id is one conversation; null turns come first; null or unknown roles get the
    role that is cheapest; null text is empty; repeated rows are turns of their own; an empty table gives no rows; other
    columns are not read.
    """
    spark = turns.sparkSession
    C.prepare(spark)
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(C.partitions(spark), *order).withColumn("part", F.spark_partition_id())
    dealt = C.materialise(dealt, "turns")
    # at most two conversations of a partition go on elsewhere, so these tables have a row or two for each partition
    wide = dealt.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where(F.col("a") < F.col("b")).select(F.col("conv_id").alias("_c"))
    parted = dealt.select("conv_id", "turn", "role", "text", "part").join(F.broadcast(wide), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    n = C.partitions(spark)
    matrices = parted.repartition(n, "conv_id", "part").sortWithinPartitions("conv_id", "part", *order[1:]).select("conv_id", "part", "role").mapInArrow(_matrices(costs), "conv_id bigint, part int, matrix binary")
    cuts = matrices.groupBy("conv_id").applyInArrow(_boundaries(costs), "conv_id bigint, part int, entry int, leave int, is_last boolean")
    cuts = C.materialise(cuts, "cuts").select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "entry", "leave", "is_last")
    known = dealt.join(F.broadcast(cuts), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left").drop("_c", "_p")
    return known.repartition(n, "conv_id", "part").sortWithinPartitions("conv_id", "part", *order[1:]).mapInArrow(_render(costs), _OUT)


def render(fragments: DataFrame) -> DataFrame:
    """(conv_id, rendered): whole conversations, for such as fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("part", "place", "fragment")))
    return fragments.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["fragment"]), "").alias("rendered"))
