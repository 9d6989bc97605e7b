"""Correct text of other languages is no wrong encoding."""

import random
import re

import numpy as np

from daftar.llm import ciphers, mojibake

TEXTS = {
    "ru": "Суд принял решение по делу. Договор купли-продажи вступает в силу с момента подписания. Работодатель обязан выплатить заработную плату в течение десяти дней. Истец подал жалобу в апелляционную инстанцию. Ответчик не явился в судебное заседание. Закон защищает права потребителей. Срок исковой давности составляет три года.",
    "de": "Das Gericht hat über den Antrag entschieden. Der Käufer muss den Kaufpreis für das Grundstück spätestens am fünften Tag überweisen. Die Kündigung ist schriftlich zu erklären. Für Schäden haftet der Schuldner gemäß § 12. Die Größe der Fläche wird durch Bevollmächtigte geprüft. Ähnliche Gründe können natürlich berücksichtigt werden. Öffentliche Behörden müssen das Gesetz ausführen.",
    "pl": "Sąd orzekł w sprawie o zapłatę. Umowa sprzedaży wymaga formy pisemnej pod rygorem nieważności. Pozwany wniósł odpowiedź na pozew w ciągu czternastu dni. Pracodawca jest obowiązany wypłacić wynagrodzenie. Właściciel nieruchomości może żądać zwrotu kosztów. Świadek złożył zeznania przed sądem. Księga wieczysta zawiera łączną powierzchnię gruntów.",
    "tr": "Mahkeme davanın kabulüne karar verdi. Satış sözleşmesi yazılı şekilde yapılmalıdır. İşveren ücreti on gün içinde ödemek zorundadır. Davacı temyiz başvurusunda bulundu. Davalı duruşmaya katılmadı. Kanun tüketicilerin haklarını korur. Zamanaşımı süresi üç yıldır. Şirket müdürü görevini özenle yürütmelidir. Ağır kusur hâlinde tazminat ödenir.",
    "he": "בית המשפט קיבל את התביעה. חוזה המכר נכנס לתוקף ביום החתימה. המעסיק חייב לשלם שכר בתוך עשרה ימים. התובע הגיש ערעור לבית המשפט העליון. הנתבע לא התייצב לדיון. החוק מגן על זכויות הצרכן. תקופת ההתיישנות היא שלוש שנים. העד מסר עדות בפני השופט.",
    "el": "Το δικαστήριο έκανε δεκτή την αγωγή. Η σύμβαση πώλησης ισχύει από την υπογραφή της. Ο εργοδότης οφείλει να καταβάλει τον μισθό εντός δέκα ημερών. Ο ενάγων άσκησε έφεση. Ο εναγόμενος δεν εμφανίστηκε στη δίκη. Ο νόμος προστατεύει τα δικαιώματα των καταναλωτών. Η προθεσμία παραγραφής είναι τρία χρόνια.",
    "zh": "法院受理了本案。买卖合同自签字之日起生效。用人单位应当在十日内支付工资。原告提起上诉。被告未出庭。法律保护消费者的权利。诉讼时效为三年。",
    "fa": "دادگاه دعوی را پذیرفت. قرارداد فروش از زمان امضا معتبر است. کارفرما باید دستمزد را ظرف ده روز بپردازد. خواهان پژوهش خواست. گواه در برابر دادرس گفته‌های خود را بیان کرد. چنین قانونی حقوق مصرف‌کنندگان را پاس می‌دارد.",
    "es": "El tribunal aceptó la demanda. El contrato de compraventa será válido desde la firma. El empleador deberá pagar el salario en diez días. La acción prescribió según el artículo vigésimo. El señor Muñoz presentó una apelación. También habrá daños y perjuicios según la ley española.",
    "cs": "Soud rozhodl o žalobě. Kupní smlouva nabývá účinnosti dnem podpisu. Zaměstnavatel je povinen vyplatit mzdu do deseti dnů. Žalobce podal odvolání. Žalovaný se k jednání nedostavil. Zákon chrání práva spotřebitelů. Promlčecí lhůta činí tři roky.",
}


def test_correct_text_of_other_languages_is_not_garbled(spark):
    rnd, rows = random.Random(0), []
    for lang, text in TEXTS.items():
        some = [x.strip() for x in re.split("[.。]", text) if x.strip()]
        rows += [(10**9 + len(rows), ". ".join(rnd.choice(some) for _ in range(rnd.randrange(3, 2 * len(some)))) + ".", f"src_{lang}") for _ in range(25)]
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    both = base.unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = {r.doc_id for r in mojibake.found(both).collect()}
    assert not [x for x in found if x >= 10**9]
    assert found == {r.doc_id for r in mojibake.found(base).collect()} != set()


def test_sparse_pairs_equal_dense_ones():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 3, (30, 30)).astype(float)
    joint = rng.random((6, 6))
    joint /= joint.sum()
    allowed, first = (rng.random((6, 30)) < 0.7).astype(float), rng.random((6, 30))
    i, j = np.nonzero(n)
    got = ciphers.learn(i, j, n[i, j], joint, allowed, first, iterations=5)
    b = first * allowed
    b /= b.sum(1, keepdims=True)
    weight = 5.0 * b
    for _ in range(5):
        pb, bp = joint @ b, joint.T @ b
        w = n / np.maximum(b.T @ pb, 1e-300)
        expected = b * (pb @ w.T) + b * (bp @ w) + weight
        b = expected / expected.sum(1, keepdims=True)
    assert np.allclose(got, expected / np.maximum(expected.sum(0, keepdims=True), 1e-300))


def test_many_characters_in_one_source_are_learned_in_little_memory():
    rng = np.random.default_rng(2)
    symbols = 20_000
    i, j = rng.integers(0, symbols, 50_000), rng.integers(0, symbols, 50_000)
    joint = np.full((8, 8), 1 / 64)
    assert ciphers.learn(i, j, np.ones(50_000), joint, np.ones((8, symbols)), rng.random((8, symbols)), iterations=2).shape == (8, symbols)
