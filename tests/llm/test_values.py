import random

import pytest

from sigmill.llm import canonical, encoding, queries

DRUGS = [(1, "HAUNDBEADRIL", "PAUNDXAUO"), (2, "SKIRHUADRIL", None), (3, "XÉSKRORENDIL", None), (4, "TROSLÈNÊPTAL / DRIOLKRUOQUAR", None), (5, "ŠEAXTROYSTÀR", ""), (6, None, "LELTBEAIX")]
EVENTS = [(11, "RASH – DELAYED"), (12, "SUEÑO AGITADO"), (13, "TEMPERATURE ABOVE 39 °C"), (14, "DOR NO CORAÇÃO"), (15, None)]
DRUG_COLUMNS, EVENT_COLUMNS = "ref_id long, drug_name string, brand_name string", "ref_id long, event_pt string"
CELL_COLUMNS = "dataset_id string, drug_text string, drug_text_source string, event_pt string, ref_id string, text string, token string"


def cell_rows(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], CELL_COLUMNS)


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(DRUGS, DRUG_COLUMNS), spark.createDataFrame(EVENTS, EVENT_COLUMNS)


@pytest.mark.parametrize("chain", sorted(encoding.CHAINS))
@pytest.mark.parametrize("text", ["XÉSKRORENDIL", "ŠEAXTROYSTÀR", "DOR NO CORAÇÃO", "日本"])
def test_chains_round_trip(chain, text):
    bad = encoding.garble(text, encoding.CHAINS[chain])
    assert bad != text and encoding.restore(bad, encoding.CHAINS[chain]) == (text, True)


def test_partly_garbled_text_is_restored_in_part():
    assert encoding.undo("PULMONÀRY PALLÃ˜R", "cp1252") == ("PULMONÀRY PALLØR", 1)
    assert encoding.undo("ÃNIMO ÂNGULO", "cp1252") == ("ÃNIMO ÂNGULO", 0)


def test_correct_letters_beside_garbled_ones_may_stay(lists):
    assert encoding.restore("QUARVÃ‹ÄŠIVAST", ("cp1252",)) == ("QUARVËĊIVAST", True)
    assert encoding.fits("QUARVÃ‹ÄŠIVAST", ("cp1252",), "QUARVËÄŠIVAST") and encoding.fits("quarvÃ‹ÄŠivast", ("cp1252",), "QUARVËĊIVAST")
    assert not encoding.fits("QUARVÃ‹ÄŠIVAST", ("cp1252",), "QUARVËÄIVAST") and not encoding.fits("QUARVÃ‹ÄŠIVAST", ("cp1252",), "QUARVËÄŠIVASTX")


def test_any_number_of_letters_may_be_correct(spark, lists):
    """Twelve sequences of which every second one only looks garbled."""
    name = "ÄŠXËÄŠYÉÄŠZÈÄŠUÊÄŠVÂÄŠWÎ"
    stored = "".join(c if c in "ÄŠXYZUVW" else encoding.garble(c, ("cp1252",)) for c in name)
    drugs = spark.createDataFrame([*DRUGS, (77, name, None)], DRUG_COLUMNS)
    got = encoding.restored_values(cell_rows(spark, [("d", stored, "PROD_AI", "RASH")]), drugs, lists[1]).collect()
    assert [(r.stored_text, r.ref_id, r.restored) for r in got] == [(stored, 77, name)]
    typed = canonical.typed_names(cell_rows(spark, [("d", f"{stored} 10 MG", "DRUGNAME", "RASH")]), drugs).collect()
    assert [r.ref_id for r in typed] == [77]


def test_held_out_chains(lists, spark):
    """Of held-out words garbled in the common ways, the classifier's first reading is the word itself; clean words are in order."""
    drugs, events = lists
    model = encoding.train(drugs.selectExpr("drug_name as e").unionByName(events.selectExpr("event_pt as e")), "e")
    right = total = 0
    for text in ("FIÈVRE PASSAGÈRE", "RIÑÓN PESADO", "MÜDIGKEIT", "SVĚDĚNÍ", "PÉRDIDA", "GÊNE LÉGÈRE", "ÖDEM AM KNÖCHEL"):
        for name in ("cp1252", "latin1", "cp1250", "mac_roman", "cp850", "cp1252 twice"):
            readings = encoding.diagnose(encoding.garble(text, encoding.CHAINS[name]), *model)
            total += 1
            right += min(readings, key=lambda r: r[2])[1] == text
        assert not [r for r in encoding.diagnose(text, *model) if r[3]]
    assert right >= 0.9 * total


def test_restored_values(spark, lists):
    bad = lambda t, c: encoding.garble(t, encoding.CHAINS[c])
    rows = [
        ("d", bad("XÉSKRORENDIL", "cp1252"), "PROD_AI", bad("SUEÑO AGITADO", "mac_roman")), ("d", bad("xéskrorendil", "latin1"), None, bad("RASH – DELAYED", "cp1252 twice")),
        ("d", "X�SKRORENDIL", "PROD_AI", "SUE�O AGITADO"), ("d", "XÉSKRORENDIL", "PROD_AI", "ÇA BRÛLE"), ("d", None, None, None), ("d", "", "", ""), ("e", bad("XÉSKRORENDIL", "cp1252"), "PROD_AI", "PLAIN"),
        ("d", "A" * 40000 + bad("É", "cp1252"), "PROD_AI", bad("TEMPERATURE ABOVE 39 °C", "cp850")),
    ]
    got = {(r.field_name, r.stored_text): r.ref_id for r in encoding.restored_values(cell_rows(spark, rows), *lists).collect()}
    want = {
        ("drug_text", rows[0][1]): 3, ("event_pt", rows[0][3]): 12, ("drug_text", rows[1][1]): 3, ("event_pt", rows[1][3]): 11,
        ("drug_text", rows[2][1]): 0, ("event_pt", rows[2][3]): 0, ("drug_text", rows[7][1]): 0, ("event_pt", rows[7][3]): 13,
    }
    assert got == want
    assert encoding.restored_values(cell_rows(spark, rows).limit(0), *lists).count() == 0
    assert {r.ref_id for r in encoding.restored_values(cell_rows(spark, rows), lists[0].limit(0), lists[1].limit(0)).collect()} <= {0}


def test_a_value_garbled_in_several_datasets_comes_out_for_each(spark, lists, tmp_path):
    bad = encoding.garble("XÉSKRORENDIL", ("cp1252",))
    rows = [("d", bad, "PROD_AI", "RASH"), ("d", bad, "PROD_AI", "PAIN"), ("e", bad, None, "RASH"), (None, bad, None, "RASH"), ("f", "XÉSKRORENDIL", None, "SUE�O AGITADO"), ("g", "SUE�O AGITADO", None, "RASH")]
    for name, df in (("disproportionality_cells", cell_rows(spark, rows)), ("drug_reference", lists[0]), ("event_terms", lists[1])):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = queries.p2_found(spark, str(tmp_path))
    assert got.columns == ["dataset_id", "field_name", "stored_text", "ref_id"]
    want = [(d, "drug_text", bad, 3) for d in ("d", "e", None)] + [("f", "event_pt", "SUE�O AGITADO", 0), ("g", "drug_text", "SUE�O AGITADO", 0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


TYPED = {
    "HAUNDBEADRIL 100 MG TABS": 1, "HAUNDBBEADRIL": 1, "haundbeadril": 1, "HUANDBEADRIL": 1, "H4UNDBEADRIL": 1, "HAUNDBEA DRIL": 1, "HAUNDBEA.DRIL INJ.": 1, "HAUNDBE": 1, "PAUNDXAO": 1, "TAB. PAUNDKSAUO": 1,
    "XESKRORENDIL": 3, "XÃ‰SKRORENDIL": 3, "X�SKRORENDIL": 3, "DRIOLKRUOQUAR+TROSLENEPTAL": 4, "TROSLENEPTAL, DRIOLKRUOKUAR 25 IU": 4, "SEAXTROYSTAR": 5, "LELTBEAIKS (GENERIC)": 6,
    "TROSLENEPTAL": 0, "TRIAL ITEM BP-528": 0, "PELZWANDZWIOMENDIL": 0, "???": 0, "": 0, " ": 0, "NOT REPORTED": 0, "SKIR": 0, "DRIL": 0,
}


def test_typed_names(spark, lists):
    rows = [("d", t, s, "E") for t in TYPED for s in ("DRUGNAME", "drug_name")] + [("e", "SKIRHUADRIL", "DRUGNAME", "E"), ("e", "PAUNDXAUO", "DRUGNAME", "E"), ("e", "HAUNDBBEADRIL", "PROD_AI", "E"), ("e", "HAUNDBBEADRIL", None, "E"), ("e", None, "DRUGNAME", None)]
    got = canonical.typed_names(cell_rows(spark, rows), lists[0]).collect()
    assert len(got) == len(TYPED) and {r.drug_text: r.ref_id for r in got} == TYPED and {r.dataset_id for r in got} == {"d"}
    assert canonical.typed_names(cell_rows(spark, rows).limit(0), lists[0]).count() == 0


def test_no_list_and_ties(spark, lists):
    texts = spark.createDataFrame([("ABCDEFGHIJ",), ("ABCDEFGHIJ",), (None,)], "text string")
    model = encoding.train(lists[0], "drug_name")
    none = spark.createDataFrame([], "ref_id long, form string")
    assert [(r.text, r.ref_id) for r in canonical.map_values(texts, none, model).collect()] == [("ABCDEFGHIJ", 0)]
    same = spark.createDataFrame([(9, "ABCDEFGHIJ"), (7, "ABCDEFGHIJ"), (8, None), (6, "")], "ref_id long, form string")
    assert [r.ref_id for r in canonical.map_values(texts, same, model).collect()] == [7]


def test_every_name_is_known_by_its_first_half(spark, lists):
    """However the weights round, a token of just the least similarity covers its entry."""
    rng = random.Random(8)
    names = ["".join(rng.choice("ABDEFGIJKLMNOPRSTUVX") for _ in range(rng.choice((9, 11, 12, 13)))) for _ in range(60)]
    model = encoding.train(lists[0], "drug_name")
    entries = spark.createDataFrame(list(enumerate(names, 1)), "ref_id long, form string")
    got = canonical.map_values(spark.createDataFrame([(n[: -(-len(n) // 2)],) for n in names if len(n) > 10], "text string"), entries, model)
    want = {n[: -(-len(n) // 2)]: k for k, n in enumerate(names, 1) if len(n) > 10}
    assert {r.text: r.ref_id for r in got.collect()} == want


def test_all_readings_take_part(spark, lists):
    model = encoding.train(lists[0], "drug_name")
    text = encoding.garble("ĚÜŠÉÇ", ("cp1252",))
    readings = [canonical.plain(r[1]) for r in sorted(encoding.diagnose(text, *model), key=lambda r: r[2])]
    assert len(set(readings)) > 3
    got = {r.token for r in canonical.tokens_of(spark.createDataFrame([(text,)], "text string"), model, joined=False).collect()}
    assert got == {w for r in (canonical.plain(text), *readings) for w in canonical._TOKEN.findall(r) if len(w) >= canonical.TOKEN_LETTERS}


def edited(word, times, rng, letters="ABDEFGIJKLMNOPRSTUVX"):
    for _ in range(times):
        i, c = rng.randrange(len(word)), rng.choice(letters)
        word = rng.choice((word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :]))
    return word


def test_every_similar_pair_is_a_candidate():
    rng, pairs = random.Random(4), []
    for _ in range(30000):
        entry = "".join(rng.choice("ABDEFGIJKLMNOPQRSTUVX") for _ in range(rng.randint(5, 18)))
        pairs.append((edited(entry.replace("AU", "O"), rng.randint(1, 3), rng), entry))
    close = canonical.similarities(*map(list, zip(*pairs)))
    pairs = [(t, e) for (t, e), s in zip(pairs, close) if s >= canonical.TOKEN_SIMILARITY]
    assert sum(len(t) in (9, 10) and len(e) >= 12 for t, e in pairs) > 50
    assert not [(t, e) for t, e in pairs if not (canonical.variants(t, canonical.DELETIONS) | canonical.token_halves(t)) & (canonical.variants(e, canonical.DELETIONS) | canonical.entry_halves(e))]


def test_three_letters_left_out(spark, lists):
    rows = [("d", t, "DRUGNAME", "E") for t in ("HANDEADIL", "HUNDBADRL")]
    assert {r.drug_text: r.ref_id for r in canonical.typed_names(cell_rows(spark, rows), lists[0]).collect()} == {"HANDEADIL": 1, "HUNDBADRL": 1}


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distances():
    rng = random.Random(5)
    pairs = [("abcd", "abdc"), ("abc", ""), ("kitten", "sitting"), ("", ""), ("a" * 5000, "b"), ("x😀y", "xy")]
    pairs += [("".join(rng.choice("ABC") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ABC") for _ in range(rng.randint(0, 30)))) for _ in range(500)]
    most = [rng.randint(0, 5) for _ in pairs]
    want = [min(osa(a, b), m + 1) if len(a) < 1000 else m + 1 for (a, b), m in zip(pairs, most)]
    assert canonical.distances(*map(list, zip(*pairs)), most).tolist() == want
    assert canonical.distances([], [], []).tolist() == []
    assert canonical.similarities(["FLYMREALTOPHENT", "ABC"], ["FLYMREALTOFENT", "ABC"]).tolist() == [pytest.approx(1 - 0.25 / 15), 1.0]
