"""The waterfall, the pairing and the clusters against plain step-by-step versions, with one entity and one amount that hold a third of the rows."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from tidemark.operators import coalescing, containment, fusion, pairing, waterfall

DAY = datetime.date(2024, 1, 1)


def plain_waterfall(movements, events):
    """In order of date and id, with floats as money; rows as in ``book``."""
    open_ = {e["id"]: dict(e, out=float(e["outstanding"]), gross=float(e["amount"]), used=False) for e in events}
    lines, left = [], {}
    for m in sorted(movements, key=lambda m: (m["date"], m["id"])):
        cash = float(m["cash"])
        if cash <= 0.01:
            continue
        kind = "ar" if m["direction"] == "inflow" else "ap"
        n = 0

        def add(stage, e, component, gross, net, confidence, m=m):
            nonlocal n
            n += 1
            lines.append((m["id"], n, stage, e["id"], component, round(gross * 100), round(net * 100), round(confidence, 4)))

        def pay(e, stage, price, net, confidence, applied=None, kind=kind, add=add):
            past = e["status"] == "paid"
            tail = "_historical" if past else ""
            add(stage + tail, e, kind, price, net, confidence)
            fee = price - net
            if fee > 0.0101 and kind == "ar":
                add(f"{stage}_fee{tail}", e, "fee", 0, -fee, confidence)
            if past:
                e["used"] = True
            else:
                e["out"] = 0 if applied is None else max(0, e["out"] - applied)
                if e["out"] <= 0.0101 or e["gross"] <= 0.0101:
                    e["status"] = "paid"

        price = lambda e: e["gross"] if e["status"] == "paid" else e["out"]
        link = open_.get(m["link"])
        if link and link["event_type"] == kind and (link["out"] > 0.0101 or link["status"] == "paid"):
            p = price(link)
            pay(link, "direct_link", p if p > cash else p, cash, 0.98)
            left[m["id"]] = ("direct_link", 0, lines)
            continue
        found = [e for e in open_.values() if e["event_type"] == kind and e["entity_id"] in m["entities"]]
        found = sorted((e for e in found if (not e["used"] if e["status"] == "paid" else e["out"] > 0.0101)), key=lambda e: (e["expected_date"], e["id"]))
        processor = m["processor"] and kind == "ar"
        hit = next((e for e in found if abs(price(e) - cash) < 0.005), None)
        stage, confidence = "exact", 0.92
        if hit is None and processor:
            hit = next((e for e in found if price(e) > 0.0101 and 0 <= (price(e) - cash) / price(e) <= 0.08 + 1e-12), None)
            if hit:
                stage, confidence = "exact_with_fee", 0.90 if price(hit) - cash > 0.0101 else 0.92
        if hit:
            pay(hit, stage, price(hit), cash, confidence)
            left[m["id"]] = (stage, 0, lines)
            continue
        count, owner = 0, None
        for e in [e for e in found if e["status"] != "paid"] + [e for e in found if e["status"] == "paid"]:
            if cash <= 0.0101 or count >= 3:
                break
            p = price(e)
            if p <= 0.0101:
                continue
            fee = (p - cash) / p if processor and cash < p else 0
            if fee > 0.08 + 1e-12:
                continue
            if fee < 0.005:
                fee = 0
            if owner not in (None, e["entity_id"]):
                continue
            penalty = (0, 0.05, 0.10)[count]
            if fee or cash + 0.0101 >= p:
                net = cash if fee else p
                pay(e, "fifo", p, net, max(0.5, 0.82 - penalty))
                cash -= net
            else:
                pay_net = cash
                past = "_historical" if e["status"] == "paid" else ""
                add("fifo_partial" + past, e, kind, pay_net, pay_net, max(0.5, 0.80 - penalty))
                if past:
                    e["used"] = True
                else:
                    e["out"] = max(0, e["out"] - pay_net)
                    if e["out"] <= 0.0101:
                        e["status"] = "paid"
                cash = 0
            count, owner = count + 1, e["entity_id"]
        left[m["id"]] = (None, max(0, round(cash * 100)), lines)
    return sorted(lines), {k: v[1] for k, v in left.items()}


def book(seed):
    rng = random.Random(seed)
    entity = lambda: "hot" if rng.random() < 0.4 else rng.choice("abcdef")
    money = lambda: Decimal(rng.choice([100, 250, 97, 480, 2000, rng.randint(1, 3000)])) + Decimal(rng.choice(["0", "0.01", "0.5"]))
    events, movements = [], []
    for i in range(150):
        amount = money()
        status = rng.choice(["open", "open", "partially_paid", "paid"])
        out = {"open": amount, "partially_paid": (amount / 2).quantize(Decimal("0.01")), "paid": Decimal(0)}[status]
        events.append({"id": f"e{i:03}", "event_type": rng.choice(["ar", "ar", "ap"]), "entity_id": entity(), "amount": amount, "outstanding": out, "expected_date": DAY + datetime.timedelta(rng.randint(0, 40)), "status": status})
    for i in range(160):
        who = sorted({entity(), *([entity()] if rng.random() < 0.15 else [])}) if rng.random() < 0.95 else []
        cash = rng.choice([money(), (rng.choice(events)["amount"] * Decimal("0.96")).quantize(Decimal("0.01")), rng.choice(events)["amount"], Decimal(5000)])
        link = rng.choice(events)["id"] if rng.random() < 0.1 else ("nothing" if rng.random() < 0.05 else None)
        movements.append({"id": f"m{i:03}", "direction": rng.choice(["inflow", "inflow", "outflow"]), "cash": cash, "date": DAY + datetime.timedelta(rng.randint(0, 40)), "entities": who, "link": link, "processor": rng.random() < 0.4})
    return movements, events


EVENTS = "id string, event_type string, entity_id string, amount decimal(18,2), outstanding decimal(18,2), expected_date date, status string"
MOVEMENTS = "id string, direction string, cash decimal(18,2), date date, entities array<string>, link string, processor boolean"


def frames(spark, movements, events):
    m = spark.createDataFrame([tuple(x[c.split()[0]] for c in MOVEMENTS.split(", ")) for x in movements], MOVEMENTS)
    e = spark.createDataFrame([tuple(x[c.split()[0]] for c in EVENTS.replace("(18,2)", "").split(", ")) for x in events], EVENTS)
    return m.repartition(3), e.repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_waterfall(spark, seed):
    from tidemark.plans.reconcile import entity_components

    movements, events = book(seed)
    m, e = frames(spark, movements, events)
    entities = spark.createDataFrame([(x,) for x in ["hot", *"abcdef"]], "entity_id string")
    got = waterfall.allocated(m, e, entity_components(m, e, entities)).collect()
    lines = sorted((r["movement_id"], r["line"], r["stage"], r["event_id"], r["component"], r["gross"], r["net"], round(r["confidence"], 4)) for r in got if r["line"])
    want, left = plain_waterfall(movements, events)
    assert lines == want
    assert {r["movement_id"]: r["net"] for r in got if not r["line"]} == left
    assert all(r["stage"] == "review" for r in got if not r["line"] and r["net"] > 100_000)
    stages = {x[2] for x in lines}
    assert seed or {"direct_link", "exact", "exact_with_fee", "fifo", "fifo_partial", "fifo_historical"} <= stages
    per = defaultdict(set)
    for mid, _, stage, eid, component, *_ in lines:
        if stage.startswith("fifo") and component != "fee":
            per[mid].add((eid, next(x["entity_id"] for x in events if x["id"] == eid)))
    assert max(map(len, per.values())) == 3
    assert all(len({o for _, o in v}) == 1 for v in per.values())


def test_processor_band_and_caps():
    rows = [{"id": f"e{i}", "entity_id": "a", "component": "ar", "cents": c, "due": c, "status": "open"} for i, c in enumerate([10_000, 20_000, 30_000, 40_000, 50_000])]
    pay = {"component": "ar", "entities": ["a"], "link": None, "processor": True, "cents": 9_700}
    lines, left = waterfall.allocate(waterfall.Book(rows), pay, exact_fee=0.0)
    assert ([(x.stage, x.net) for x in lines], left) == ([("processor", 9_700), ("processor_fee", -300)], 0)
    lines, left = waterfall.allocate(waterfall.Book(rows), pay | {"processor": False, "cents": 400_000})
    assert ([(x.stage, x.gross, x.confidence) for x in lines], left) == ([("fifo", 10_000, 0.82), ("fifo", 20_000, pytest.approx(0.77)), ("fifo", 30_000, pytest.approx(0.72))], 340_000)
    assert waterfall.allocate(waterfall.Book([]), pay) == ([], 9_700)


def plain_pairs(legs):
    order = sorted((x for x in legs if None not in x), key=lambda x: (x[2], x[3], x[1], x[0]))
    used, pairs = set(), []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a[0] not in used and b[0] not in used and a[4] == b[4] and a[1] != b[1] and a[3] != b[3] and (b[2] - a[2]).days <= 1:
                used |= {a[0], b[0]}
                pairs.append((a[0], b[0]) if a[1] == "outflow" else (b[0], a[0]))
    return sorted(pairs)


@pytest.mark.parametrize("seed", range(2))
def test_pairs(spark, seed):
    rng = random.Random(seed)
    legs = []
    for i in range(400):
        amount = Decimal(500) if rng.random() < 0.4 else Decimal(rng.randint(1, 12) * 100)
        legs.append((f"m{i:03}", rng.choice(["inflow", "outflow"]), DAY + datetime.timedelta(rng.randint(0, 25)), rng.choice("ABC"), amount))
    legs += [("n1", "inflow", None, "A", Decimal(1)), ("n2", "outflow", DAY, None, Decimal(1)), ("n3", "outflow", DAY, "B", None)]
    df = spark.createDataFrame(legs, "movement_id string, direction string, date date, account string, amount decimal(18,2)").repartition(3)
    got = pairing.pair_once(df).collect()
    assert sorted((r["outflow_id"], r["inflow_id"]) for r in got) == plain_pairs(legs)
    assert pairing.pair_once(df.filter("false")).count() == 0


def plain_clusters(rows):
    seen, kept = set(), []
    for r in sorted(rows, key=lambda r: (r["source"], r["source_id"])):
        if (r["source"], r["source_id"]) not in seen and abs(r["amount"]) >= Decimal("0.01"):
            seen.add((r["source"], r["source_id"]))
            kept.append(r)
    kept.sort(key=lambda r: (-coalescing.PRIORITY.get(r["source"], 0), r["date"], r["source_id"]))
    cluster = {}
    for i, a in enumerate(kept):
        if id(a) not in cluster:
            cluster[id(a)] = a
            for b in kept[i + 1 :]:
                if id(b) in cluster or a["amount"] != b["amount"] or abs((a["date"] - b["date"]).days) > 1:
                    continue
                ordered = a["order_id"] is not None and a["order_id"] == b["order_id"]
                x, y = ((r["counterparty"] or "").lower() or None for r in (a, b))
                close = x is None or y is None or x == y or len(min(x, y, key=len)) >= 3 and (max(x, y, key=len).startswith(min(x, y, key=len)) or max(x, y, key=len).endswith(min(x, y, key=len))) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.4
                if ordered or close or a["source"] != b["source"] and (a["order_id"] or b["order_id"]):
                    cluster[id(b)] = a
    return sorted((r["source"], r["source_id"], f"{cluster[id(r)]['source']}:{cluster[id(r)]['source_id']}") for r in kept)


@pytest.mark.parametrize("seed", range(2))
def test_clusters(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        amount = Decimal(500) if rng.random() < 0.4 else Decimal(rng.choice([100, -100, 250, 0, 12]))
        name = rng.choice(["acme", "acmeworks", "works", "ac", "ab", None, "zephyr", "Zephyr"])
        rows.append({"source": rng.choice(["plaid", "qbo", "xero", "stripe", "other"]), "source_id": f"s{i:03}", "amount": amount, "date": DAY + datetime.timedelta(rng.randint(0, 40)), "counterparty": name, "order_id": rng.choice([None, None, None, "o1", "o2"]), "account": rng.choice([None, "A"]), "raw_description": "x"})
    rows += rows[:20]
    schema = "source string, source_id string, amount decimal(18,2), date date, counterparty string, order_id string, account string, raw_description string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.replace("(18,2)", "").split(", ")) for r in rows], schema).repartition(3)
    members = coalescing.coalesced(df)
    assert sorted((r["source"], r["source_id"], r["cluster"]) for r in members.collect()) == plain_clusters(rows)
    assert coalescing.canonical(members).agg({"n": "sum"}).first()[0] == len(plain_clusters(rows))


def test_keys_within_keys(spark):
    rng = random.Random(9)
    left = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(120)}
    right = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(120)}
    frame = lambda keys: spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
    got = {(r["a"], r["b"]) for r in containment.within(frame(left), frame(right)).collect()}
    assert got == {(a, b) for a in left for b in right if a == b or min(len(a), len(b)) >= 8 and (a in b or b in a)}


def plain_fusion(movements, events):
    """In order of date and id; money in cents."""
    book = [dict(e, due=round(e["outstanding"] * 100)) for e in sorted(events, key=lambda e: (e["expected_date"], e["id"]))]
    out = {}
    for m in sorted(movements, key=lambda m: (m["date"], m["id"])):
        cash = round(m["cash"] * 100)
        kind = "ar" if m["direction"] == "inflow" else "ap"
        if cash <= 1:
            continue
        names = dict(m["names"])
        link = next((e for e in book if e["id"] == m["link"] and e["event_type"] == kind), None)
        if link:
            out[m["id"]] = (link["id"], "direct_link", cash)
            link["due"] = 0
            continue
        found = [e for e in book if e["event_type"] == kind and e["entity_id"] in names and e["due"] > 1]
        same = next((e for e in found if e["due"] == cash and names[e["entity_id"]] >= 0.95), None)
        if same:
            out[m["id"]] = (same["id"], "exact", cash)
            same["due"] = 0
            continue
        near = sorted(found, key=lambda e: abs((e["expected_date"] - m["date"]).days))[:15]
        strict = sum(e["due"] == cash for e in near) > 1
        best, top = None, 0
        for e in near:
            name, ratio, late = names[e["entity_id"]], cash / e["due"], (m["date"] - e["expected_date"]).days
            if strict and not (name >= 0.6 and m["known"] == e["entity_id"]):
                continue
            math = 0.6 * (1 - abs(ratio - 1) * 5 if 0.92 <= ratio <= 1.08 else 0.1) + 0.25 * max(0, 1 - abs(late) / (90 if kind == "ap" else 45))
            math += 0.015 * (ratio < 1 and 0.005 <= (e["due"] - cash) / e["due"] <= 0.05) + 0.005 * (0.97 <= ratio <= 0.99 and late <= 10)
            weights = [0.4 + 0.1 * (math > 0.85), 0.4, 0.2 + 0.05 * (name > 0.85)]
            apart = abs(math - 0.5) + abs(0.5 - name) + abs(math - name)
            score = (math * weights[0] + 0.5 * weights[1] + name * weights[2]) / sum(weights) - (0.05 if apart > 1.5 else 0.03 if apart > 1 else 0)
            if score > top:
                best, top = e, score
        if best is None or top < 0.5:
            out[m["id"]] = (None, "none", 0)
            continue
        net = min(cash, best["due"])
        best["due"] -= net
        out[m["id"]] = (best["id"], "fusion", net)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_fusion(spark, seed):
    from tidemark.plans.reconcile import entity_components

    rng = random.Random(seed)
    movements, events = book(seed)
    for m in movements:
        m["names"] = [(e, rng.choice([0.3, 0.6, 0.9, 1.0])) for e in m["entities"]]
        m["known"] = rng.choice([None, *m["entities"]])
        m["link"] = m["link"] if rng.random() < 0.3 else None
    _, e = frames(spark, movements, events)
    rows = [(m["id"], m["direction"], m["cash"], m["date"], m["known"], m["names"], m["link"], 0.05) for m in movements]
    df = spark.createDataFrame(rows, "id string, direction string, cash decimal(18,2), date date, known string, names array<struct<entity_id:string,similarity:double>>, link string, most_fee double").repartition(3)
    connected = spark.createDataFrame([(m["entities"], m["link"]) for m in movements], "entities array<string>, link string")
    entities = spark.createDataFrame([(x,) for x in ["hot", *"abcdef"]], "entity_id string")
    got = {r["movement_id"]: (r["event_id"], r["method"], r["net"]) for r in fusion.fused(df, e, entity_components(connected, e, entities)).collect()}
    assert got == plain_fusion(movements, events)
    assert {x[1] for x in got.values()} == {"direct_link", "exact", "fusion", "none"}
    paid = defaultdict(int)
    for event, method, net in got.values():
        if method == "fusion":
            paid[event] += net
    assert all(n <= 100 * next(x["outstanding"] for x in events if x["id"] == k) for k, n in paid.items())


@pytest.mark.parametrize("hot", [0, 150, 20_000])
def test_clusters_of_common_amounts(spark, monkeypatch, hot):
    """Amounts that are scanned by kinds give what lists give, and the tables behind the sources are read once."""
    monkeypatch.setattr(coalescing, "HOT", hot)
    rng = random.Random(5)
    rows = [(rng.choice(["plaid", "qbo", "stripe"]), f"s{i:03}", Decimal(rng.choice([500, 500, 250])), DAY + datetime.timedelta(rng.randint(0, 60)), rng.choice(["acme", "acmeworks", None, " "]), rng.choice([None, None, "o1"]), rng.choice([None, "A", "B"]), f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "source string, source_id string, amount decimal(18,2), date date, counterparty string, order_id string, account string, raw_description string")
    plain = [dict(zip(df.columns, r, strict=True)) | {"counterparty": (r[4] or "").strip() or None} for r in rows]
    members = coalescing.coalesced(df)
    assert sorted((r["source"], r["source_id"], r["cluster"]) for r in members.collect()) == plain_clusters(plain)
    lists, others = coalescing.parts(df)
    assert (others.count() == 0) == (hot == 20_000)
    assert (lists.count() == 0) == (hot == 0)
    got = coalescing.canonical_lists(lists).unionByName(coalescing.canonical(others))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, coalescing.canonical(members).collect()))


def test_sources_are_read_once(spark):
    from tidemark.sources import domain

    plan = domain.source_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("Relation [l_orderkey") == 1


def test_names_are_never_looked_for_by_short_grams(spark, monkeypatch):
    """Short grams are common to all names, so that the pairs to compare grew as the square of the names."""
    used, plain = [], containment.grams
    monkeypatch.setattr(containment, "grams", lambda key, n=containment.LEAST: used.append(n) or plain(key, n))
    rng = random.Random(2)
    keys = lambda k: sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(k)})
    left, right = keys(120), keys(120)
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    for n in (1, 3):
        got = sorted((r["a"], r["b"]) for r in containment.within(frame(left), frame(right), n).collect())
        assert got == sorted((a, b) for a in left for b in right if a == b or (len(a) >= n and len(b) >= n and (a in b or b in a)))
    assert min(used) >= 8


def test_only_movements_with_links_meet_events_by_id(spark):
    m = spark.createDataFrame([("a", "e1", "ar"), ("b", None, "ar"), ("c", "e9", "ar")], "id string, link string, component string")
    linked = spark.createDataFrame([("e1", "ar", "C1")], "link string, component string, linked_entity string")
    assert {(r["id"], r["linked_entity"]) for r in waterfall.with_links(m, linked).collect()} == {("a", "C1"), ("b", None), ("c", None)}
