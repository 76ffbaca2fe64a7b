"""Held-out wordings in eleven languages: five that decline and five that do not, of each."""

import pytest

from sparlance.llm.language import language_of
from sparlance.llm.pairs import defects_of, refuses

DECLINES = {
    "en": ["I won't be able to look that up for you.", "That is not something I'm permitted to share.", "Sorry, this lies outside my remit.", "I'd prefer not to write that statement.", "Providing those salaries would violate our privacy rules, so I must refuse."],
    "de": ["Dazu darf ich nichts sagen.", "Diese Daten herauszugeben ist mir untersagt.", "Bedaure, dabei kann ich dir nicht helfen.", "Ich verweigere die Auskunft über Gehälter.", "Es ist mir nicht erlaubt, solche Anfragen zu bearbeiten."],
    "fr": ["Je ne suis pas habilité à consulter ces données.", "Navré, cela m'est interdit.", "Il n'est pas possible de vous fournir cette requête.", "Je préfère ne pas écrire cela.", "Malheureusement, je ne peux vous aider sur ce sujet."],
    "es": ["No estoy autorizado a revelar esos datos.", "Disculpe, no me es posible ayudarle con eso; no tengo acceso.", "Me niego a escribir esa consulta.", "Lamentablemente está prohibido consultar esa tabla.", "No voy a generar una consulta sobre los salarios."],
    "pt": ["Não estou autorizado a revelar esses dados.", "Infelizmente não consigo ajudar com esse pedido.", "Prefiro não escrever essa consulta.", "É proibido mostrar esses valores, lamento.", "Peço desculpa, mas não tenho acesso a essa tabela."],
    "pl": ["Nie jestem upoważniony do udostępniania tych danych.", "Przepraszam, nie mogę odpowiedzieć na to pytanie.", "Odmawiam napisania takiego zapytania.", "Niestety nie mam dostępu do tej tabeli.", "Nie wolno mi ujawniać wynagrodzeń."],
    "ru": ["Я не уполномочен раскрывать эти сведения.", "К сожалению, помочь с этим я не смогу.", "Отказываюсь составлять такой запрос.", "У меня нет доступа к этой таблице.", "Мне запрещено отвечать на такие вопросы."],
    "zh": ["我没有权限查看这些数据。", "抱歉，这个问题我不便回答。", "恕难从命。", "我拒绝编写这样的查询。", "很遗憾，我无法满足这个请求。"],
    "ja": ["そのデータをお見せすることはできません。", "申し訳ございませんが、お答えを控えさせていただきます。", "そのようなクエリの作成はお断りします。", "残念ながら、私には閲覧する権限がありません。", "この件については回答いたしかねます。"],
    "tr": ["Bu verileri paylaşmaya yetkili değilim.", "Üzgünüm, bu konuda size yardım edemem.", "Böyle bir sorgu yazmayı reddediyorum.", "Bu tabloya erişimim yok.", "Maalesef bu soruyu cevaplayamıyorum."],
    "el": ["Δεν έχω δικαίωμα να δω αυτά τα δεδομένα.", "Λυπάμαι, δεν μπορώ να βοηθήσω με αυτό.", "Αρνούμαι να γράψω τέτοιο ερώτημα.", "Δυστυχώς απαγορεύεται η πρόσβαση.", "Δεν μου επιτρέπεται να απαντήσω."],
}
ANSWERS = {
    "en": ["I cannot tell which year you mean: 2019 or 2020?", "The table holds one row per city, keyed by id.", "Do you want closed accounts left out as well?", "First the rows are grouped by month and then summed.", "I can't find a column called area. Did you mean size?"],
    "de": ["Meinen Sie das Bestelldatum oder das Lieferdatum?", "Die Tabelle enthält eine Zeile für jede Stadt.", "Soll ich stornierte Aufträge mitzählen?", "Zuerst werden die Zeilen nach Monat gruppiert und dann summiert.", "Es sind insgesamt zwölf Einträge."],
    "fr": ["Voulez-vous dire la date de commande ou celle de livraison ?", "La table contient une ligne par ville.", "Faut-il compter aussi les comptes fermés ?", "Les lignes sont d'abord groupées par mois puis additionnées.", "Il y a douze entrées au total."],
    "es": ["¿Se refiere a la fecha del pedido o a la de entrega?", "La tabla contiene una fila por ciudad.", "¿Debo contar también las cuentas cerradas?", "Primero se agrupan las filas por mes y luego se suman.", "Hay doce registros en total."],
    "pt": ["Refere-se à data do pedido ou à da entrega?", "A tabela contém uma linha por cidade.", "Devo contar também as contas fechadas?", "Primeiro as linhas são agrupadas por mês e depois somadas.", "Há doze registos no total."],
    "pl": ["Czy chodzi o datę zamówienia, czy o datę dostawy?", "Tabela zawiera jeden wiersz dla każdego miasta.", "Czy mam liczyć także zamknięte konta?", "Najpierw wiersze są grupowane według miesiąca, a potem sumowane.", "W sumie jest dwanaście wpisów."],
    "ru": ["Вы имеете в виду дату заказа или дату доставки?", "В таблице одна строка на каждый город.", "Учитывать ли закрытые счета?", "Сначала строки группируются по месяцам, затем суммируются.", "Всего двенадцать записей."],
    "zh": ["您是指下单日期还是发货日期？", "该表每个城市一行。", "需要把已关闭的账户也计算在内吗？", "先按月份分组，然后求和。", "一共有十二条记录。"],
    "ja": ["注文日と納品日のどちらを指していますか？", "この表には都市ごとに一行があります。", "閉鎖された口座も数えますか？", "まず月ごとにまとめ、次に合計します。", "全部で十二件です。"],
    "tr": ["Sipariş tarihini mi yoksa teslim tarihini mi kastediyorsunuz?", "Tabloda her şehir için bir satır var.", "Kapalı hesapları da sayayım mı?", "Önce satırlar aya göre gruplanır, sonra toplanır.", "Toplam on iki kayıt bulunuyor."],
    "el": ["Εννοείτε την ημερομηνία παραγγελίας ή παράδοσης;", "Ο πίνακας έχει μία γραμμή για κάθε πόλη.", "Να μετρηθούν και οι κλειστοί λογαριασμοί;", "Πρώτα οι γραμμές ομαδοποιούνται ανά μήνα και μετά αθροίζονται.", "Υπάρχουν συνολικά δώδεκα εγγραφές."],
}


def test_refusals_held_out():
    found = [(lang, s) for lang, texts in DECLINES.items() for s in texts if refuses(s)]
    wrong = [(lang, s) for lang, texts in ANSWERS.items() for s in texts if refuses(s)]
    total = sum(map(len, DECLINES.values())) + sum(map(len, ANSWERS.values()))
    missed = [s for texts in DECLINES.values() for s in texts if not refuses(s)]
    print(len(found), missed, wrong)
    assert total >= 100 and len(found) >= 0.9 * 55 and len(found) >= 0.9 * (len(found) + len(wrong)), (missed, wrong)


def test_language_held_out():
    """Every answer against an English question: the other ten languages are other ones, English is not."""
    question = "How many orders did each customer place in the last year, and which of them were late?"
    got = {lang: ["other_language" in defects_of(question, s) for s in texts] for lang, texts in ANSWERS.items()}
    assert not any(got.pop("en"))
    hits = [x for xs in got.values() for x in xs]
    print({k: v for k, v in got.items() if not all(v)})
    assert sum(hits) >= 0.9 * len(hits)


@pytest.mark.parametrize("text, lang", [("Tohle mi bohužel není jasné, který rok je to a proč.", "cs"), ("Saya tidak dapat membantu anda dengan itu.", "id"), ("Helaas kan ik u daar niet mee helpen, het is niet toegestaan.", "nl"), ("죄송하지만 도와드릴 수 없습니다.", "ko")])
def test_more_languages(text, lang):
    assert language_of(text) == lang
    assert refuses(text) == (lang != "cs")


def test_every_triggered_defect_is_listed():
    assert defects_of("How many orders did each customer place in the last year?", "Leider kann ich Ihnen dabei nicht helfen, das ist mir nicht erlaubt.") == ["other_language", "refusal"]
    assert defects_of("How many orders are there?", "Voici la requête que vous avez demandée pour le client:\nSELECT count(*) FROM orders WHERE") == ["other_language", "truncated"]


def test_words_are_learned_from_labelled_documents(spark):
    from sparlance.llm.language import fit_words

    rows = [(i, f"die Tabelle wird gefüllt und Name{i} geprüft", "de") for i in range(20)] + [(100 + i, f"the table is filled and Name{i} gets checked", " EN ") for i in range(20)]
    rows += [(200, None, "de"), (201, "x", None), (202, "y", "undetermined"), (None, "z", "de")]
    got = fit_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got["gefüllt"] == "de" and got["checked"] == "en" and not any(w.startswith("name") for w in got)
    assert fit_words(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}
