import pytest

from sparlance.llm import garble

SENTENCES = {
    "de": "Für die Prüfung wäre die Größe überflüssig, weil schon höchstens fünf Einträge gültig sind.",
    "fr": "Après vérification, la requête renvoie des lignes, ce qui paraît élevé « été ».",
    "pl": "Użytkownik prosił o łączną wartość, więc sprawdź kolumnę źródła i średnia.",
    "ru": "Следующий вопрос уточняет период, остальные условия прежние; таблица хранится отдельно.",
    "tr": "Şema güncellendi, ilişkiler aynı kaldı, değerini taşır çoğunlukla.",
    "zh": "请先检查外键，再进行汇总。该查询返回很多行。",
    "ja": "外部キーを確認してから集計してください。テーブルには一行が入ります。",
    "el": "Η επόμενη ερώτηση αλλάζει μόνο την περίοδο· συνολικά εγγραφές.",
    "en": "It’s “unclear” – naïve café costs €5, about £4… ±2 °C, ½ unit, § 3, Ã, Â, Ð and ß are valid.",
    "box": "├── id\n└── name\n│ x │ 👍🏽 ✅",
}
CHANNELS = [
    ("de", "utf-8", "latin-1"), ("de", "utf-8", "cp1252"), ("fr", "utf-8", "cp1250"), ("de", "utf-8", "cp437"), ("fr", "utf-8", "cp850"), ("de", "utf-8", "mac_roman"), ("ru", "utf-8", "latin-1"), ("ru", "utf-8", "cp1251"),
    ("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "latin-1"), ("ru", "koi8_r", "cp1251"), ("ru", "cp866", "cp1251"), ("pl", "cp1250", "latin-1"), ("pl", "iso8859_2", "latin-1"), ("tr", "cp1254", "latin-1"), ("el", "cp1253", "latin-1"),
    ("zh", "utf-8", "latin-1"), ("zh", "gbk", "latin-1"), ("ja", "cp932", "latin-1"), ("ja", "utf-8", "cp1252"), ("en", "utf-8", "cp1252"), ("box", "utf-8", "latin-1"), ("el", "utf-8", "latin-1"), ("tr", "utf-8", "cp1252"),
]
SCHEMA = "doc_id long, text string, key string, word string, n int, restored string, channel string"


def misread(text, written, read):
    data = text.encode(written, "ignore")
    if read == "cp1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)
    return data.decode(read, "replace").replace("�", "")


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "k", "w", 1, "r", "c") for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def found(spark):
    clean = [(1000 * i + j, s) for i, s in enumerate(SENTENCES.values()) for j in range(30)]
    bad = [(50_000 + i, SENTENCES[lang] if (t := misread(SENTENCES[lang], w, r)) is None else t) for i, (lang, w, r) in enumerate(CHANNELS)]
    twice = misread(misread(SENTENCES["fr"], "utf-8", "cp1252"), "utf-8", "cp1252")
    lost = SENTENCES["de"].encode("latin-1").decode("utf-8", "replace")
    entities = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in misread(SENTENCES["de"], "utf-8", "latin-1"))
    dropped = "".join(c for c in misread(SENTENCES["box"], "utf-8", "latin-1") if not 0x80 <= ord(c) < 0xA0)
    odd = [(70_000, "Café ​﻿ ＦＵＬＬ ¯\\_(ツ)_/¯"), (70_001, SENTENCES["fr"].upper()), (70_002, None), (70_003, ""), (70_004, "plain"), (70_005, "Elmarqueø Torraluní"), (70_006, "x" * 400_000 + " é"), (None, "é"), (70_007, SENTENCES["ru"].upper()), (70_008, SENTENCES["el"].upper()), (70_009, "ОТСУТСТВУЕТ"), (70_010, "É ù à « x » ½ ©"), (70_011, "“ATÉ AMANHÔ")]
    rows = clean + bad + odd + [(60_000, twice), (60_001, lost), (60_002, entities), (60_003, dropped), (60_004, "Zarenñ – " + misread("Zarenñholm", "utf-8", "cp1250")), (60_000, twice), (60_005, "name Quizanelvi¨ª Pelkas")]
    df = docs(spark, rows)
    return df, {r["doc_id"] for r in garble.garbled_documents(df).collect()}, {r["doc_id"]: r for r in garble.restored_documents(df).collect()}


@pytest.mark.parametrize("i", range(len(CHANNELS)))
def test_channel_is_found(found, i):
    assert 50_000 + i in found[1], CHANNELS[i]


@pytest.mark.parametrize("k", range(60_000, 60_006))
def test_other_damage_is_found(found, k):
    assert k in found[1]


def test_correct_texts_are_no_case(found):
    assert not [k for k in found[1] if k < 50_000 or k >= 70_000]


@pytest.mark.parametrize("i", [i for i, (lang, w, r) in enumerate(CHANNELS) if w == "utf-8" and lang in ("de", "fr", "ru", "tr", "el", "box", "zh")] + [8, 9, 10, 11])
def test_text_is_restored(found, i):
    assert found[2][50_000 + i]["restored_text"] == SENTENCES[CHANNELS[i][0]]


def test_double_lost_and_entities(found):
    assert found[2][60_000]["restored_text"] == SENTENCES["fr"]
    assert found[2][60_002]["restored_text"] == SENTENCES["de"]
    assert found[2][60_001]["restored_text"] == SENTENCES["de"]


COPIED = [("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "latin-1"), ("ru", "koi8_r", "cp1251"), ("pl", "cp1250", "latin-1"), ("tr", "cp1254", "latin-1"), ("el", "cp1253", "latin-1"), ("box", "utf-8", "latin-1")]


@pytest.mark.parametrize("lang, written, read", COPIED)
def test_copies_do_not_outvote_the_original(spark, lang, written, read):
    """A damaged passage that far more documents carry than the original, as plain copies and in front of other text."""
    bad = misread(SENTENCES[lang], written, read)
    if written == "utf-8":
        bad = "".join(c for c in bad if not 0x80 <= ord(c) <= 0x9F)
    clean = [(1000 * i + j, f"{s}\nNo {j}") for i, s in enumerate(SENTENCES.values()) for j in range(30)]
    parts = SENTENCES[lang].split()
    clean += [(20_000 + j, " ".join(parts[: j % 4] + parts[j % 4 + 1 :])) for j in range(12)]  # in a few other passages
    copies = [(50_000 + j, bad) for j in range(200)] + [(60_000 + j, f"{bad}\nRow {j}: schöne Grüße, naïve café.") for j in range(200)]
    df = docs(spark, clean + copies)
    found = {r["doc_id"] for r in garble.garbled_documents(df).collect()}
    assert found == {k for k, _ in copies}
    if lang in ("ru", "el"):
        texts = {r["restored_text"] for r in garble.restored_documents(docs(spark, clean + copies[:200])).collect()}
        assert texts == {SENTENCES[lang]}


@pytest.mark.parametrize("read", ["cp1251", "koi8_r", "cp1253", "cp866"])
def test_single_sequence_in_code_pages_of_other_scripts(spark, read):
    bad = "Rows für Kunden".encode().decode(read)
    df = docs(spark, [(i, f"Zeile {i} für Kunden") for i in range(30)] + [(i, SENTENCES["ru"]) for i in range(100, 130)] + [(900, bad)])
    assert [(r["doc_id"], r["restored_text"]) for r in garble.restored_documents(df).collect()] == [(900, "Rows für Kunden")]


def test_empty_tables(spark):
    assert garble.garbled_documents(docs(spark, [])).count() == 0
    assert garble.restored_documents(docs(spark, [(1, None), (2, "ascii")])).count() == 0


def model_of(words):
    import numpy as np

    pairs, counts = np.zeros(garble.PAIRS, dtype=np.int64), {}
    for w, n in words.items():
        for c in set(w):
            if ord(c) > 127:
                counts[c] = counts.get(c, 0) + n
        for a, b in zip(("", *w), (*w, "")):
            pairs[garble.pair_bucket(a, b)] += n
            pairs[garble.pair_bucket(a, "any")] += n
    return garble.Model(counts, 1000, pairs)


def test_lattice_has_wildcards_for_lost_bytes():
    model = model_of({"café": 12, "cave": 30, "Łukasz": 5, "größe": 9, "über": 30, "привет": 20})
    lost = garble.LOST
    assert garble.decode("caf" + lost, None, model, {"café": 12}) == "café"  # by the word's frequency
    assert garble.decode("cafÃ", "latin_1", model, {"café": 12}) == "café"  # the second byte was dropped
    assert garble.decode("cafÃ" + lost, "cp1252", model, {"café": 12}) == "café"
    assert garble.decode("Åukasz", "latin_1", model) == "Łukasz"  # a name the corpus need not have
    assert garble.decode("gr" + lost * 2 + "e", None, model, {"größe": 9}) == "größe"
    assert garble.decode("gr" + lost + "e", None, model, {"größe": 9}) == "größe"
    assert garble.decode("пр" + lost + "вет", None, model, {"привет": 20}) == "привет"
    assert garble.decode(lost, None, model) is None and garble.decode("x" + lost, None, model) is None
    assert garble.decode("cave", "latin_1", model) is None
    ends = {c for _, c, _ in garble.edges("Ã" + lost, "latin_1", model)[0]}
    assert {"é", "ö", "ü", "Ã"} <= ends and "Ł" not in ends
