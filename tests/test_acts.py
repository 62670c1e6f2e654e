"""The reading of planning acts against written truth, brute force over scopes, hand cases of conditions, mutated candidates."""

from __future__ import annotations

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from zonaris.functions import acts as A
from zonaris.operators import acts as O

FORMS = {
    "height": [("maksymalna wysokość zabudowy – {v} m", "max"), ("wysokość budynków nie większa niż {v} m", "max"), ("wysokość zabudowy: do {v} m", "max"), ("wysokość budynków {v} m", "exact")],
    "bio": [("minimalna powierzchnia biologicznie czynna – {v}%", "min"), ("udział powierzchni biologicznie czynnej co najmniej {v} %", "min"), ("powierzchnia terenu biologicznie czynnego nie mniejsza niż {v}% powierzchni działki", "min")],
    "coverage": [("wskaźnik powierzchni zabudowy maksymalnie {v}%", "max"), ("powierzchnia zabudowy nie może przekraczać {v}%", "max"), ("maksymalny wskaźnik zabudowy: 0,{v}", "max")],
    "roof": [("nachylenie połaci dachowych od {v}° do 50°", "range"), ("kąt nachylenia dachu {v}–50°", "range")],
    "plot": [("minimalna powierzchnia działki – 1 0{v} m2", "min")],
}
TRAPS = ["zgodnie z art. {v} ust. 2", "uchwała nr XII/{v}/2019 z dnia {d} maja 2019 r.", "Dz. U. z 2019 r. poz. {v}", "wysokość ogrodzeń do 2 m", "szerokość drogi {v} m", "według § {v} ust. 3 pkt 2"]
SYMBOLS = ["1MN", "2MN", "7U", "3MW/U", "12KDZ", "5ZP"]


def written(rnd):
    """(text, [(family, operator, value, symbols)], [(word, symbols)]): an act of sections, points and letters with what it says."""
    text, truth, spots = "", [], []

    def rule(symbols):
        nonlocal text
        v = rnd.randint(10, 49)
        if rnd.random() < 0.35:
            text += rnd.choice(TRAPS).format(v=v, d=rnd.randint(1, 28))
            return
        family = rnd.choice(list(FORMS))
        form, operator = rnd.choice(FORMS[family])
        text += form.format(v=v)
        value = 1000.0 + v if family == "plot" else float(v)
        truth.append((family, operator, value, symbols))

    for k in range(rnd.randint(1, 6)):
        own = sorted(rnd.sample(SYMBOLS, rnd.randint(0, 3)))
        spot = f"miejsce{k}x"
        lead = "" if not own else f"dla terenów oznaczonych symbolami {', '.join(own)} "
        text += f"§ {k + 1}. Ustalenia {lead}{spot}:\n"
        spots.append((spot, own))
        for i in range(rnd.randint(1, 4)):
            if rnd.random() < 0.3:
                inner = sorted(rnd.sample(SYMBOLS, 1))
                spot = f"miejsce{k}y{i}"
                text += f"{i + 1}) na terenie {inner[0]} {spot}:\n"
                spots.append((spot, inner))
                for j in range(rnd.randint(1, 3)):
                    text += f"{'abc'[j]}) "
                    rule(inner)
                    text += ",\n"
            else:
                text += f"{i + 1}) "
                rule(own)
                text += ";\n"
    return text, truth, spots


@pytest.mark.parametrize("seed", range(200))
def test_quantities_and_scopes_are_those_written(seed):
    text, truth, spots = written(random.Random(seed))
    got = [(q.family, q.operator, q.low if q.low is not None else q.high, q.symbols) for q in A.quantities(text)]
    assert got == truth, text
    for q in A.quantities(text):
        assert any(c.isdigit() for c in text[q.start : q.end]) and text[q.noun_start : q.noun_end].strip()
    assert A.scope_of(text, [text.index(w) for w, _ in spots]) == [s for _, s in spots]


def test_forms_of_values():
    one = lambda text: [(q.family, q.operator, q.low, q.high, q.flags) for q in A.quantities(text)]
    assert one("wysokość budynków:\n- mieszkalnych – maksimum 10,5 m\n- gospodarczych do 6 m") == [("height", "max", None, 10.5, ["inherited"]), ("height", "max", None, 6.0, ["inherited"])]
    assert one("powierzchnia zabudowy do 0,35 (35%)") == [("coverage", "max", None, 35.0, ["double_notation"])]
    assert one("powierzchnia zabudowy do 0,35 (50%)") == [("coverage", "max", None, 35.0, ["double_notation_mismatch", "ratio_to_percent"])]
    assert one("nachylenie dachu od 300 do 450") == [("roof", "range", 30.0, 45.0, ["degree_artifact"])]
    assert one("nie więcej niż trzy kondygnacje") == [("storeys", "max", None, 3.0, ["number_word"])]
    assert one("intensywność zabudowy 30%, minimalna powierzchnia działki 0,12 ha") == [("intensity", "exact", 0.3, 0.3, ["percent_to_ratio"]), ("plot", "min", 1200.0, None, ["hectare_to_m2"])]
    assert one("wysokość 500 m, wysokość 30%") == [] and one("") == [] and one("12 m") == []
    assert one("Wysokość jest ważna. Budynek ma 12 m") == []  # a sentence ends between them
    assert one("wysokość " + "bardzo " * 20 + "12 m") == []  # too far


def test_innermost_ranges_by_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        ranges = [(a, a + rnd.randint(0, 30)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 15)))]
        places = [rnd.randint(-2, 95) for _ in range(30)]
        want = [min((k for k, (a, b) in enumerate(ranges) if a <= p < b), key=lambda k: (-ranges[k][0], ranges[k][1], -k), default=-1) for p in places]
        assert A.innermost(ranges, places) == want


def test_long_texts_take_time_in_proportion():
    text, _, _ = written(random.Random(3))
    long = (text * (300_000 // len(text) + 1))[:300_000]
    start = time.perf_counter()
    A.scope_of(long, list(range(0, 300_000, 100)))
    assert time.perf_counter() - start < 3  # 0.4 s on an idle core


SAME = [
    ("zakaz lokalizacji garaży blaszanych", "zakazuje się budowy garaży blaszanych"),
    ("dopuszcza się lokalizację budynków gospodarczych", "dopuszczalna jest realizacja budynków gospodarczych"),
    ("nie dopuszcza się reklam", "zakaz reklam"),
    ("wyklucza się budowę wiat", "zakaz sytuowania wiat"),
    ("zakaz budowy ogrodzeń z wyjątkiem ogrodzeń ażurowych", "zakazuje się wznoszenia ogrodzeń za wyjątkiem ogrodzeń ażurowych"),
    ("nakaz zachowania zieleni", "nakazuje się zachowanie zieleni"),
    ("dopuszcza się parkingi wzdłuż drogi", "dopuszczalne parkingi wzdłuż drogi"),
    ("zakaz zabudowy w strefie A", "zakazuje się zabudowy w strefie A"),
    ("obowiązuje zachowanie drzew", "nakaz zachowania drzew"),
    ("zezwala się na lokalizację parkingów", "możliwa realizacja parkingów"),
    ("zabrania się budowy garaży", "garaży nie dopuszcza się"),
    ("dopuszcza się obiekty małe oprócz obiektów handlowych", "zezwala się na obiekty małe z wyłączeniem obiektów handlowych"),
]
OTHER = [
    ("zakaz lokalizacji garaży", "dopuszcza się lokalizację garaży"),
    ("zakaz lokalizacji garaży", "zakaz lokalizacji wiat"),
    ("zakaz lokalizacji garaży", "zakaz lokalizacji garaży z wyjątkiem garaży podziemnych"),
    ("zakaz ogrodzeń oprócz ogrodzeń ażurowych", "zakaz ogrodzeń oprócz ogrodzeń pełnych"),
    ("dopuszcza się parkingi wzdłuż drogi", "dopuszcza się parkingi"),
    ("dopuszcza się parkingi wzdłuż drogi", "dopuszcza się parkingi od strony drogi"),
    ("zakaz zabudowy w strefie A", "zakaz zabudowy w strefie B"),
    ("nakaz zachowania zieleni", "dopuszcza się zieleń"),
    ("dopuszcza się budynki gospodarcze", "dopuszcza się budynki mieszkalne"),
    ("nie zakazuje się reklam", "zakazuje się reklam"),
    ("zakaz budowy garaży w pasie drogi", "zakaz budowy garaży poza pasem drogi"),
    ("wymagane ogrodzenie", "dopuszczalne ogrodzenie"),
    ("zakaz drzew", "zakaz zieleni"),
]


@pytest.mark.parametrize("pair", SAME)
def test_paraphrases_share_a_key(pair):
    a, b = map(A.condition_key, pair)
    assert a == b and a.startswith("is:") and "what:" in a


@pytest.mark.parametrize("pair", OTHER)
def test_other_rules_have_other_keys(pair):
    a, b = map(A.condition_key, pair)
    assert a != b and "what:" in a and "what:" in b


def test_findings_by_clause_and_sentence():
    text = "§ 1. Dla terenu 1MN: zakaz reklam. Dopuszcza się wiaty; nakaz zachowania zieleni.\n1) w terenie 2U zakaz garaży (art. 5 ust. 2).\n§ 2. Wysokość 12 m."
    got = [(f["modality"], f["key"].split("|")[1], f["symbols"]) for f in A.findings(text)]
    assert got == [("forbidden", "what:reklam", ["1MN"]), ("allowed", "what:wiat", ["1MN"]), ("required", "what:ziele", ["1MN"]), ("forbidden", "what:garaż", ["2U"])]


def candidates(rnd, n):
    docs, rows = [], []
    for d in range(n):
        v = rnd.randint(10, 98)
        text = f"§ 1. Dla terenu 1MN ustala się: maksymalna wysokość   zabudowy\n– {v},5 m; minimalna powierzchnia biologicznie czynna {v % 50 + 1}%."
        docs.append((d, text))
        good = {"symbol": "1MN", "family": "height", "operator": "max", "value": v + 0.5, "raw": f"{v},5 m", "quote": f"maksymalna wysokość zabudowy – {v},5 m"}
        changes = [
            (None, {}), (None, {"value": None}), (None, {"symbol": None, "operator": "exact"}), ("parameter_unknown", {"family": rnd.choice(["volume", "", "Height"])}), ("operator_not_allowed", {"operator": rnd.choice(["min", "", "MAX"])}),
            ("quote_empty", {"quote": rnd.choice([None, "", "  \n"])}), ("quote_not_found", {"quote": good["quote"].replace("zabudowy", "zabudowa")}), ("raw_empty", {"raw": rnd.choice([None, " "])}), ("raw_not_in_quote", {"raw": f"{v + 1},5 m"}),
            ("raw_truncated", {"raw": f"{v}", "value": float(v)}), ("raw_truncated", {"raw": f"{v % 10},5 m"}), ("value_underivable", {"raw": "wysokość"}), ("value_mismatch", {"value": v + 1.5}), ("symbol_out_of_scope", {"symbol": "2MN"}),
        ]
        for why, change in changes:
            rows.append({"doc": d, "why": why, **good, **change})
    return docs, rows


def test_first_failing_gates_of_mutated_candidates(spark):
    rnd = random.Random(6)
    docs, rows = candidates(rnd, 25)
    for r, got in zip(rows, (O.gate(docs[r["doc"]][1], [r], False)[0] for r in rows), strict=True):
        assert got["reason"] == r["why"], (r, got)
        if r["why"] is None:
            assert docs[r["doc"]][1][got["start"] : got["end"]].startswith("maksymalna") and got["derived"] == float(r["raw"].split(" ")[0].replace(",", "."))
    near = {"symbol": None, "family": "height", "operator": "max", "value": None, "raw": "12,5 m", "quote": "maksymalna wysokosć zabudowy – 12,5 m"}
    text = "maksymalna wysokość zabudowy – 12,5 m"
    assert O.gate(text, [near], False)[0]["reason"] == "quote_not_found" and O.gate(text, [near], True)[0]["edits"] == 1
    assert O.gate(text, [{**near, "quote": near["quote"].replace("12", "13")}], True)[0]["reason"] == "quote_not_found"  # digits must be equal
    d = spark.createDataFrame([*docs, (None, None)], "doc int, text string")
    c = [(k, r["doc"], *(r[x] for x in ("symbol", "family", "operator", "value", "raw", "quote"))) for k, r in enumerate(rows)]
    c += [(9000, 77, "1MN", "height", "max", None, "1 m", "x"), (9001, None, "1MN", "height", "max", None, "1 m", "x")]
    v = docs[0][1].split("– ")[1].split(" m")[0]
    c += [(9002, 0, "1MN", "bio", "min", None, f"{docs[0][1].rsplit(' ', 1)[1][:-1]}", "minimalna powierzchnia biologicznie czynna " + docs[0][1].rsplit(" ", 1)[1][:-1])]
    got = {r["candidate"]: r["reason"] for r in O.verified(spark.createDataFrame(c, "candidate int, doc int, symbol string, family string, operator string, value double, raw string, quote string"), d, "doc", "text").collect()}
    first = {}
    for k, r in enumerate(rows):
        want = r["why"]
        if want is None:
            key = (r["doc"], r["symbol"], r["operator"])
            want = "duplicate" if key in first else None
            first.setdefault(key, k)
        assert got[k] == want
    assert got[9000] == got[9001] == "document_missing" and got[9002] is None and v


def test_pairs_that_contradict(spark):
    d = spark.createDataFrame([(1, "intensywność zabudowy minimum 0,9; intensywność zabudowy maksimum 0,5")], "doc int, text string")
    c = spark.createDataFrame([(1, 1, None, "intensity", "min", None, "0,9", "intensywność zabudowy minimum 0,9"), (2, 1, None, "intensity", "max", None, "0,5", "intensywność zabudowy maksimum 0,5")], "candidate int, doc int, symbol string, family string, operator string, value double, raw string, quote string")
    assert [r["reason"] for r in O.verified(c, d, "doc", "text").orderBy("candidate").collect()] == ["pair_conflict"] * 2


def test_scores_are_those_of_a_plain_logistic(spark):
    rnd = random.Random(7)
    weights = [rnd.uniform(-2, 0) for _ in O.FEATURES]
    made = O.weights_artifact("t", 1.5, weights, [("high", 0.8), ("mid", 0.5), ("low", 0.0)])
    rows = [(k, [rnd.choice([0.0, 1.0, 0.5]) for _ in O.FEATURES]) for k in range(50)]
    for r in O.scored(spark.createDataFrame(rows, "k int, features array<double>"), made).collect():
        p = 1 / (1 + math.exp(-1.5 - sum(w * x for w, x in zip(weights, r["features"], strict=True))))
        assert r["probability"] == pytest.approx(p, abs=1e-6) and r["score"] == pytest.approx(100 * p, abs=0.51)
        assert r["band"] == ("high" if r["probability"] >= 0.8 else "mid" if r["probability"] >= 0.5 else "low") and r["weights_version"] == "t"
    with pytest.raises(ValueError):
        O.weights_artifact("t", 1.5, weights[:-1], [("low", 0.0)])
    with pytest.raises(ValueError):
        O.weights_artifact("t", 1.5, weights, [("low", 0.0), ("high", 0.5)])
    with pytest.raises(ValueError):
        O.scored(spark.createDataFrame(rows, "k int, features array<double>"), json.dumps({**json.loads(made), "features": ["x"]}))


def test_whole_parse_and_its_edges(spark):
    text = "§ 1. Dla terenów 1MN i 2MN:\n1) wysokość zabudowy do 12 m;\n2) w terenie 2MN wysokość zabudowy do 9 m od strony drogi;\n3) wysokość zabudowy do 12 m;\n§ 2. Powierzchnia zabudowy do 40%."
    d = spark.createDataFrame([(1, text, "x"), (2, "bez ustaleń", "x"), (None, None, "x"), (3, "", "x"), (4, "wysokość zabudowy do 12 m", "x")], "doc int, text string, symbol string")
    values = O.parsed(d, "doc", "text")
    got = {(r["doc"], r["symbol"], r["family"], r["high"]): r for r in values.collect()}
    assert got.keys() == {(1, "1MN", "height", 12.0), (1, "2MN", "height", 12.0), (1, "2MN", "height", 9.0), (1, None, "coverage", 40.0), (4, None, "height", 12.0)}
    assert got[1, "1MN", "height", 12.0]["value_kind"] == "unconditional" and got[1, "2MN", "height", 9.0]["value_kind"] == "conflict"
    assert got[1, "1MN", "height", 12.0]["quote"] == "wysokość zabudowy do 12 m" == text[got[1, "1MN", "height", 12.0]["start"] : got[1, "1MN", "height", 12.0]["end"]]
    status = {r["doc"]: (r["status"], r["values"], r["conflicts"]) for r in O.validated(d, values, "doc").collect()}
    assert status == {1: ("review", 4, 2), 2: ("empty", 0, 0), None: ("empty", 0, 0), 3: ("empty", 0, 0), 4: ("ok", 1, 0)}
    assert O.parsed(d.limit(0), "doc", "text").collect() == [] and O.findings_of(d.limit(0), "doc", "text").collect() == []
    assert O.quantities_of(d.withColumn("n", F.lit(1)), "doc", "text").count() == 5
