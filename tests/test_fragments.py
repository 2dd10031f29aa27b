"""Fragments of reads against a plain reading of the rules."""

import random
import re

from pyspark.sql import functions as F

from loomseq.operators import fragments as R

READS = "component long, contig string, anchor long, read string, record int, flag int, mapq int, pos long, cigar string, sequence string, sa string, nm int, start int"


def ops(cigar):
    return [(int(n), o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar or "")]


def span(o):
    return sum(n for n, k in o if k in "MDN=X")


def anchor(o, at, bp):
    lo, hi, total, big = bp - 150, bp + 151, 0, False
    for n, k in o:
        shared = max(0, min(at + n, hi) - max(at, lo))
        if k in "M=X":
            total += shared
        elif k in "DN":
            total += shared
            big |= n >= 20 and shared > 0
        elif k == "I" and lo <= at < hi:
            total += n
            big |= n >= 20
        at += n if k in "MDN=X" else 0
    return total, big


def clips(o):
    o = [x for x in o if x[1] != "H"]
    return (o[0][0] if o and o[0][1] == "S" else 0), (o[-1][0] if len(o) > 1 and o[-1][1] == "S" else 0)


def own(o, n):
    a, b = clips(o)
    q = sum(x for x, k in o if k in "MI=X")
    end = n - b if n - b > a else a + q
    return (a, end) if n > 0 and q > 0 and a < end <= n else None


def tagged(o, n):
    a, b = clips(o)
    q = sum(x for x, k in o if k in "MI=X")
    start = a if a else n - b - q if b else 0 if q == n else -1
    return (start, start + q) if q > 0 and n > 0 and start >= 0 and start + q <= n else None


def between(a, b):
    if (a["contig"], a["rev"]) != (b["contig"], b["rev"]):
        return -1
    x, y = (b, a) if b["q"][0] < a["q"][0] else (a, b)
    return y["q"][0] - x["q"][1] - max(0, y["rs"] - x["re"])


def plain_split(rows):
    supp, out = {}, []
    for r in rows:
        q = own(ops(r["cigar"]), len(r["sequence"] or ""))
        if r["flag"] & 0x800 and not r["flag"] & 0x100 and q:
            supp.setdefault((r["component"], r["read"]), []).append((bool(r["flag"] & 16), q))
    for r in rows:
        s = r["sequence"] or ""
        q = own(ops(r["cigar"]), len(s))
        if r["flag"] & 0x900 or not r["sa"] or not q:
            continue
        bp = r["anchor"]

        def row(contig, rs, o, q, rev, mapq, nm, primary, reliable, bp=bp):
            length, big = anchor(o, rs, bp)
            return {"contig": contig, "rs": rs, "re": rs + span(o), "q": q, "rev": rev, "mapq": mapq, "nm": nm, "primary": primary, "reliable": reliable, "anchor": length, "big": big}

        me = row(r["contig"], r["pos"], ops(r["cigar"]), q, bool(r["flag"] & 16), r["mapq"], -1 if r["nm"] is None else r["nm"], True, True)
        known, tags, core = supp.get((r["component"], r["read"])), [], [me]
        for e in r["sa"].split(";"):
            if not e:
                break
            contig, pos, strand, cigar, mapq, nm = e.split(",")
            t = tagged(ops(cigar), len(s))
            if not t or t[1] - t[0] < 50:
                continue
            ok = known is None
            if known is not None:
                best = (0.0, 1e9, 1e9)
                for rev, k in known:
                    iou = max(0, min(k[1], t[1]) - max(k[0], t[0])) / (max(k[1], t[1]) - min(k[0], t[0]))
                    if rev == (strand == "-") and iou > best[0]:
                        best = (iou, abs(k[0] - t[0]), abs(k[1] - t[1]))
                ok = best[0] >= 0.9 and best[1] <= 5 and best[2] <= 5
            tags.append(row(contig, max(0, int(pos) - 1), ops(cigar), t, strand == "-", int(mapq), int(nm), False, ok))
            core += [tags[-1]] if ok else []
        away = lambda x: max(0, x["rs"] - bp, bp - x["re"])  # noqa: B023, E731
        key = lambda x: (-(x["anchor"] - max(0, x["nm"]) - 5 * x["big"]), -x["anchor"], -x["mapq"], x["nm"], not x["primary"], x["rs"], away(x))  # noqa: B023, E731
        there = [x for x in core if x["contig"] == r["contig"] and away(x) <= 5000]
        robust = None
        if there:
            f = min(there, key=key)
            alone = lambda x: x["q"][1] - x["q"][0] - max(0, min(x["q"][1], f["q"][1]) - max(x["q"][0], f["q"][0]))  # noqa: B023, E731
            rest = [x for x in core if x is not f]
            m = max(rest, key=alone) if rest else None
            if m and alone(m) >= 50:
                if between(f, m) < 50:
                    continue
                (fs, fe), (ms, me_) = f["q"], m["q"]
                shared = max(0, min(fe, me_) - max(fs, ms))
                j = fe if fe <= ms + 20 else fs if me_ <= fs + 20 else (max(fs, ms) + min(fe, me_)) // 2 if shared <= 20 else None
                if j is not None:
                    a, b = max(0, j - 100), min(len(s), j + 100)
                    lo, hi = (fs + 12, fe - 12) if fe - 12 > fs + 12 else (fs, fe)
                    if a < hi and b > lo:
                        if j <= lo:
                            b = min(b, lo)
                        elif j >= hi:
                            a = max(a, hi)
                        elif max(0, lo - a) >= max(0, b - hi):
                            b = lo
                        else:
                            a = hi
                    if b - a >= 50:
                        place = (f["rs"] if f["rev"] else f["re"]) if abs(j - fe) <= abs(j - fs) else (f["re"] if f["rev"] else f["rs"])
                        left, right = place <= bp + 5, place >= bp - 5
                        side = "unknown" if left == right else "left" if left else "right"
                        robust = (r["record"], a, b - a, f["anchor"], side, place, f["nm"], f["reliable"] and m["reliable"])
                        out.append(robust)
        n = 1 if robust else 0
        for t in tags:
            if n >= 3:
                break
            if between(me, t) >= 50:
                out.append((r["record"], t["q"][0], t["q"][1] - t["q"][0], t["anchor"], "unknown", -1, t["nm"], t["reliable"]))
                n += 1
    return sorted(out)


def test_split_fragments_equal_the_plain_rules(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        n = rng.randint(250, 700)
        cut = rng.randint(60, n - 60)
        rev = rng.choice((0, 0, 16))
        mine = f"{cut}M{n - cut}S" if rng.random() < 0.6 else f"{n - cut}S{cut - 5}M5I" if rng.random() < 0.5 else f"{cut - 40}M30D{40}M{n - cut}S"
        tags = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, n - 55)
            b = rng.randint(a + 40, n)
            cigar = "".join(f"{x}{o}" for x, o in ((a, "S"), (b - a, "M"), (n - b, "S")) if x)
            tags.append((a, b, rng.choice("c" * 6 + "d"), rng.randint(900, 1300), "-" if (rev > 0) == (rng.random() < 0.85) else "+", cigar, rng.randint(0, 60), rng.randint(-1, 4)))
        sa = "".join(f"{t[2]},{t[3]},{t[4]},{t[5]},{t[6]},{t[7]};" for t in tags)
        seq = "".join(rng.choice("ACGT") for _ in range(n))
        rows.append((i % 7, "c", 1000, f"r{i}", 2 * i, rev, rng.choice((30, 60)), rng.randint(500, 1100), mine, seq, sa, rng.choice((None, 0, 3)), 1))
        if rng.random() < 0.5:
            a, b, *_ = tags[0]
            a, b = a + rng.randint(0, 7), b - rng.randint(0, 7)
            rows.append((i % 7, "c", 1000, f"r{i}", 2 * i + 1, 0x800 | (16 if tags[0][4] == "-" else 0), 60, 1000, "".join(f"{x}{o}" for x, o in ((a, "S"), (b - a, "M"), (n - b, "S")) if x), seq, None, 0, 1))
    rows += [(1, "c", 1000, "x", 9001, 0, 60, 900, None, "ACGT", "c,1,+,4M,60,0;", 0, 1), (1, "c", 1000, "y", 9002, 0, 60, 900, "4M", None, "c,1,+,4M,60,0;", 0, 1), (1, "c", 1000, "z", 9003, None, 60, 900, "4M", "ACGT", "nonsense", 0, 1)]
    df = spark.createDataFrame(rows, READS)
    names = READS.replace(" long", "").replace(" int", "").replace(" string", "").split(", ")
    want = plain_split([dict(zip(names, r, strict=True)) | {"flag": r[5] or 0} for r in rows if r[3] != "z"])
    got = R.split_fragments(df).collect()
    assert sorted((r.record, r.start, r.length, r.anchor_len, r.side, r.junction, r.nm, r.reliable) for r in got) == want and len(want) > 60
    assert {r.reliable for r in got} == {True, False} and len({r.side for r in got}) == 3
    by = {r[4]: r for r in rows}
    assert all(r.sequence == by[r.record][9][r.start : r.start + r.length] for r in got) and all(f"|read={r.read}|idx={r.record}|" in r.name for r in got)
    assert R.split_fragments(df.limit(0)).count() == 0


def test_a_read_without_supplementary_records_is_reliable_by_its_tag(spark):
    seq = "A" * 300 + "C" * 80 + "G" * 220
    rows = [(1, "c", 1000, "r", 1, 0, 60, 700, "300M300S", seq, "c,1001,+,380S220M,60,1;", 0, 1)]
    got = sorted((r.start, r.length, r.junction, r.reliable) for r in R.split_fragments(spark.createDataFrame(rows, READS)).collect())
    assert got == [(280, 112, 1000, True), (380, 220, -1, True)]  # the tag's alignment is the better flank by one base
    extra = rows + [(1, "c", 1000, "r", 2, 0x800, 60, 1000, "300S300M", seq, None, 0, 1)]
    (got,) = R.split_fragments(spark.createDataFrame(extra, READS)).collect()
    assert (got.start, got.length, got.junction, got.reliable) == (380, 220, -1, False)


def plain_clips(r):
    o, s, out = ops(r["cigar"]), r["sequence"] or "", []
    a, b = clips(o)
    body = [x for x in o if x[1] != "H"]
    run = lambda seq: sum(n for n, _ in __import__("itertools").takewhile(lambda x: x[1] in "M=X", seq))
    if a >= 50:
        out.append(("clip_left", 0, a, run(body[1:]), r["pos"]))
    if b >= 50:
        out.append(("clip_right", max(0, len(s) - b), b, run(body[:-1][::-1]), r["pos"] + span(o)))
    found, q, at = [], 0, r["pos"]
    for i, (n, k) in enumerate(o):
        if k == "I" and n >= 50 and r["mapq"] == 60:
            found.append((-n, at, q, min(run(o[:i][::-1]), run(o[i + 1 :]))))
        q += n if k in "MIS=X" else 0
        at += n if k in "MDN=X" else 0
    found.sort()
    for n, p, q, left in [f for i, f in enumerate(found) if i < 2 or abs(f[1] - r["anchor"]) <= 1000][:4]:
        out.append(("insertion", q, -n, left, p))
    return [(*x, s[x[1] : x[1] + x[2]]) for x in out if s[x[1] : x[1] + x[2]]]


def test_clips_and_insertions_equal_the_plain_rules(spark):
    rng, rows = random.Random(2), []
    for i in range(200):
        o = [(rng.randint(1, 5), "H")] * (rng.random() < 0.2) + [(rng.randint(30, 90), "S")] * (rng.random() < 0.6)
        for _ in range(rng.randint(1, 7)):
            o += [(rng.randint(5, 60), rng.choice("M=X")), (rng.randint(1, 30), "M"), (rng.choice((10, 50, 70, 90)), rng.choice("IIID"))]
        o += [(rng.randint(10, 60), "M")] + [(rng.randint(30, 90), "S")] * (rng.random() < 0.6)
        n = sum(x for x, k in o if k in "MIS=X")
        rows.append((1, "c", 1500, f"r{i}", i, 0, rng.choice((60, 60, 59)), rng.choice((900, 9000)), "".join(f"{x}{k}" for x, k in o), "".join(rng.choice("ACGT") for _ in range(n)), None, None, 1))
    rows += [(1, "c", 1500, "n", 900, 0, 60, 5, None, "ACGT", None, None, 1), (1, "c", 1500, "m", 901, 0, 60, 5, "60S10M", None, None, None, 1)]
    names = READS.replace(" long", "").replace(" int", "").replace(" string", "").split(", ")
    want = sorted((r[4], *x) for r in rows for x in plain_clips(dict(zip(names, r, strict=True))))
    got = sorted((r.record, r.source, r.start, r.length, r.anchor_len, r.junction, r.sequence) for r in R.clip_and_insertion_fragments(spark.createDataFrame(rows, READS)).collect())
    assert got == want and {w[1] for w in want} == {"clip_left", "clip_right", "insertion"}
    floor = spark.createDataFrame([(2, 2), (1, 0), (3, 4), (0, 0)], "a int, b int").select(R.insertion_floor(F.col("a"), F.col("b")).alias("f"))
    assert [r.f for r in floor.collect()] == [35, 50, 50, 50]
