"""Which of an event's explanations stands: residuals over six dimensions, and where its breakpoints lie. Built-in expressions, but for the bells of breakpoints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of explanations in their order, the residuals that decide, and those that break ties.
KINDS = ("REFERENCE", "INSERTION_NON_TE", "TE", "ARTIFACT")
PRIMARY = ("structural_conflicts", "missing_required_components", "unexplained_high_complexity_bases", "read_assignment_conflicts", "reference_counterevidence", "artifact_evidence")
TIES = ("breakpoint_disagreement_bp", "label_ambiguity", "path_complexity")
#: Residuals and their names in a line, in its order.
WRITTEN = {
    "structural": "structural_conflicts", "missing": "missing_required_components", "unexplained": "unexplained_high_complexity_bases", "breakpoint": "breakpoint_disagreement_bp", "read_conflicts": "read_assignment_conflicts",
    "ref_counter": "reference_counterevidence", "artifact": "artifact_evidence", "label_ambiguity": "label_ambiguity", "path_complexity": "path_complexity",
}


def residual_line(e: Column) -> Column:
    return F.concat_ws(";", *(F.concat(F.lit(f"{n}="), e[f].cast("string")) for n, f in WRITTEN.items()))


def path_line(path: Column) -> Column:
    """start-end:label of every segment, joined by commas; NA for none. path: array<struct<start, end, label>>."""
    text = F.array_join(F.transform(path, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["label"])), ",")
    return F.when(F.coalesce(F.size(path), F.lit(0)) > 0, text).otherwise("NA")


def dominates(a: Column, b: Column) -> Column:
    """Whether a's deciding residuals are nowhere worse and somewhere better than b's."""
    no_worse, better = F.lit(True), F.lit(False)
    for f in PRIMARY:
        no_worse, better = no_worse & (a[f] <= b[f]), better | (a[f] < b[f])
    return no_worse & better


def decide(explanations: Column, closed: Column) -> Column:
    """Struct kind, qc, emit, evidence_only, unknown, family, subfamily, residuals, order: the explanation that stands, of an array of structs (kind as a number of KINDS, residuals, family, subfamily).

    The smallest sum of deciding residuals comes first, then of the others, then
    the later kind (one that dominates has the smaller sum). It must be whole,
    and a transposon or another insertion must dominate all others. `closed`:
    whether the breakpoints are. A null or empty array is incomplete.
    """
    total = lambda e, names: sum((e[f] for f in names[1:]), e[names[0]])
    ranked = F.array_sort(F.transform(F.coalesce(explanations, F.array()), lambda e, i: F.struct(total(e, PRIMARY).alias("a"), total(e, TIES).alias("b"), (-e["kind"]).alias("c"), i.alias("d"), e.alias("e"))))

    def judge(r: Column) -> Column:
        best = F.get(r, F.lit(0))["e"]
        alone = F.forall(F.slice(r, 2, 1 << 20), lambda x: dominates(best, x["e"]))
        whole = (best["missing_required_components"] <= 0) & (best["structural_conflicts"] <= 0)
        te, other = best["kind"] == KINDS.index("TE"), best["kind"] == KINDS.index("INSERTION_NON_TE")
        qc = (
            F.when(best.isNull() | ~whole, "NO_CALL_INCOMPLETE").when(te & ~alone, "TE_AMBIGUOUS").when(te & closed, "PASS_TE_CLOSED").when(te, "PASS_TE_IMPRECISE")
            .when(other & alone, "PASS_NONTE_INSERTION").otherwise("REFERENCE_OR_ARTIFACT")
        )
        emit = qc.isin("PASS_TE_CLOSED", "PASS_TE_IMPRECISE")
        named = (F.coalesce(best["subfamily"], F.lit("")) != "") & (best["subfamily"] != "UNKNOWN") & ~F.coalesce(best["family"] == "UNKNOWN", F.lit(False))
        kind = F.get(F.array(*map(F.lit, KINDS)), best["kind"].cast("int"))
        return F.struct(
            kind.alias("kind"), qc.alias("qc"), emit.alias("emit"), (emit & ~closed).alias("evidence_only"), (emit & (~closed | ~named)).alias("unknown"), best["family"].alias("family"), best["subfamily"].alias("subfamily"),
            residual_line(best).alias("residuals"), F.transform(r, lambda x: F.get(F.array(*map(F.lit, KINDS)), x["e"]["kind"].cast("int"))).alias("order"),
        )

    return F.transform(F.array(ranked), judge)[0]


#: Spread of a signal by its kind (split, insertion, clip, other), grid around the signals and its longest span, and the mass left out on either side.
SPREADS, AROUND, SPAN, TAIL = (2.0, 3.0, 6.0, 8.0), 20, 2000, 0.05
#: Positions that a step holds at once.
CELLS = 1 << 18


def breakpoint_posterior(signals: Column) -> Column:
    """Struct width, entropy, mode, mass: over the positions around an event's signals, the sum of a bell for each signal, narrower the more precise its kind is; the width of the middle 90 %, the entropy by that of even odds, and the likeliest position (the smallest of those within a billionth).

    signals: array<struct<pos, split, insertion, clip>>. Signals with a null or
    negative position count for nothing; fewer than two give width 0, entropy 0,
    mass 0 and no mode. The grid ends 2,000 behind its start.
    """
    good = F.filter(F.coalesce(signals, F.array()), lambda s: s["pos"] >= 0)
    spread = lambda s: F.when(s["split"], SPREADS[0]).when(s["insertion"], SPREADS[1]).when(s["clip"], SPREADS[2]).otherwise(SPREADS[3])
    # Bells are exponentials of every position and signal, which NumPy takes together for many events.
    measure = F.arrow_udf(lambda pos, w: _measured(pos, w), "struct<width:double,entropy:double,mode:bigint,mass:double>")
    return measure(F.transform(good, lambda s: s["pos"].cast("long")), F.transform(good, spread))


def _measured(pos: pa.Array, spread: pa.Array) -> pa.Array:
    """breakpoint_posterior of arrays of positions and spreads, a slice of events at a time."""
    n = pos.value_lengths().to_numpy().astype(np.int64)
    x, w = pos.flatten().to_numpy(), spread.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(n)])
    width, entropy, mass = (np.zeros(len(n)) for _ in range(3))
    mode = np.zeros(len(n), np.int64)
    some = np.flatnonzero(n >= 2)
    if len(some):
        filled = n > 0
        starts, own = ends[:-1][filled], (n >= 2)[filled]
        lo, hi = np.minimum.reduceat(x, starts)[own], np.maximum.reduceat(x, starts)[own]
        lo = lo - AROUND
        size = np.minimum(hi + AROUND, lo + SPAN) - lo + 1
        order = np.argsort(size, kind="stable")  # events of like size side by side
        at = 0
        while at < len(order):
            few = max(1, CELLS // int(size[order[min(at + 255, len(order) - 1)]]))
            part = order[at : at + min(few, 256)]
            at += len(part)
            _measure(some[part], lo[part], size[part], n, ends, x, w, (width, entropy, mode, mass))
    fields = [pa.array(width), pa.array(entropy), pa.array(mode, mask=n < 2), pa.array(mass)]
    return pa.StructArray.from_arrays(fields, names=["width", "entropy", "mode", "mass"])


def _measure(which: np.ndarray, lo: np.ndarray, size: np.ndarray, n: np.ndarray, ends: np.ndarray, x: np.ndarray, w: np.ndarray, out: tuple[np.ndarray, ...]) -> None:
    grid = np.arange(int(size.max()))
    inside = grid < size[:, None]
    f = np.zeros(inside.shape)
    for k in range(int(n[which].max())):  # the k-th signal of every event that has one
        has = np.flatnonzero(n[which] > k)
        i = ends[which[has]] + k
        z = (grid + (lo[has] - x[i])[:, None]) / w[i][:, None]
        f[has] += np.exp(-0.5 * z * z) / w[i][:, None]
    f[~inside] = 0
    p = f / np.cumsum(f, axis=1)[:, -1:]
    now = np.cumsum(p, axis=1)
    last = size - 1
    first = lambda level: np.where((reached := now >= level).any(1), reached.argmax(1), -1)
    a, b = first(TAIL), first(1 - TAIL)
    width, entropy, mode, mass = out
    width[which] = np.minimum(np.where(b < 0, last, b), last) - np.maximum(a, 0)
    entropy[which] = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(1) / np.log(size)
    mode[which] = lo + (p >= p.max(1, keepdims=True) * (1 - 1e-9)).argmax(1)
    mass[which] = now[:, -1]
