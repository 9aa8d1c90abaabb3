import pytest

from auditlake.llm import mojibake as M

TEXTS = ["Le rapport précédent était déjà « trop long » : l’exécution s’arrête", "Für größere Einträge übernehmen", "La función añade 3371 filas — mañana", "Проверьте, пожалуйста, пустой ввод перед слиянием", "审查报告显示得分下降", "夜間スキャンで同じ指摘が出ています", "naïve “quotes” – and 5 €"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp1251"])
def test_utf8_read_wrongly(text, wrong):
    try:
        bad = text.encode().decode(wrong)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode())
    fixed, n, _ = M.repair(bad)
    assert n and fixed == text


@pytest.mark.parametrize("text", TEXTS[:3])
def test_twice(text):
    bad = text.encode().decode("latin-1").encode().decode("latin-1")
    assert M.repair(bad)[0] == text


@pytest.mark.parametrize("text,right,wrong", [(TEXTS[3], "cp1251", "latin-1"), (TEXTS[3], "koi8-r", "cp1251"), (TEXTS[4], "gb18030", "latin-1"), (TEXTS[5], "cp932", "latin-1"), ("Für größere Einträge", "cp1252", "mac_roman"), ("Für größere Einträge", "cp1252", "cp437")])
def test_legacy(text, right, wrong):
    fixed, n, _ = M.repair(text.encode(right).decode(wrong))
    assert n and fixed == text


def test_double_byte():
    for text in TEXTS[4:6]:
        fixed, n, _ = M.repair(text.encode().decode("gb18030", "replace"))
        assert n


@pytest.mark.parametrize("text", [*TEXTS, "", " ", "plain ascii", "ATENÇÃO: A REVISÃO NÃO FOI CONCLUÍDA. É ÚNICO.", "The export shows “Ã©” where é belongs", "feeds the literal 'â€™' to the parser", "in der Liste »Ã¼« statt ü", "A run of “Ð¿Ñ€” in the log", "The replacement sign � is what it prints", "√2 ≈ 1.41 ± 0.01", "src\n├── api\n│   └── x.py", "╔══╦══╗\n║a ║b │\n└──┴──┘ ├│ ┤x├", "👩‍💻 done ✅", "Оценка упала, ошибка", "a\u00a0b", "Ελλάδα", "é́"])
def test_correct_text_stays(text):
    assert M.repair(text) == (text, 0, False)


def test_only_spans_change():
    fixed, n, _ = M.repair("René said “Ã©” and RenÃ© agreed; 审查 stays")
    assert fixed == "René said “Ã©” and René agreed; 审查 stays" and n == 1


def test_lost():
    assert M.repair("D�s que la file d�passe")[2]


def test_frame(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "  ", 5), (4, "RenÃ©", 5), (4, "RenÃ©", 5), (5, "René", 5), (6, "x" * 200_000 + " RenÃ©", 5)], "doc_id long, text string, n_spans int")
    got = M.find_garbled(df).collect()
    assert sorted(r.doc_id for r in got) == [4, 4, 6] and all(r.restored.endswith("René") for r in got)
    assert M.find_garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrong", ["cp1251", "koi8-r", "cp866", "cp1250", "cp1253", "latin-1", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", ["안녕하세요 세계, 오늘은", "great 🎉 party 🚀", "こんにちは、世界！", "नमस्ते दुनिया", "გამარჯობა მსოფლიო"])
def test_all_alphabets_of_all_families(wrong, text):
    bad = M._decode_1(text.encode(), wrong)
    if bad is None or "\ufffd" in bad:
        pytest.skip("not every byte has a character")
    assert M.repair(bad)[0] == text


def test_any_number_of_rounds():
    text = bad = "naïve café, déjà vu"
    for _ in range(5):
        bad = M._decode_1(bad.encode(), "cp1252")
    assert M.repair(bad)[0] == text


def test_russian_words_stay():
    for text in ("что такое синхронизация потоков", "ЯзЫк", "рАб и рАбота", "хДе эАп"):
        assert M.repair(text) == (text, 0, False)
