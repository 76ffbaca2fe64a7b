"""Which human language a short passage of prose is in: by script, by function words, and by words that a labelled corpus teaches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparlance.llm.common import trimmed

#: Common function words, by language (ISO 639-1).
WORDS: dict[str, str] = {
    "en": "the of and to in is are was were be been for with that this these those which what who whom whose how when where why many much by on at from as it its an a or not no nor if any there here their they them he she his her do does did have has had can could should would will shall may might must i you we me my your our us but so than then too very just only also both each every few more most other some such own same about above after again against all because before below between down during into off once out over through under until up while per won't can't don't doesn't isn't aren't i'm it's",
    "de": "der die das des dem den ein eine einer eines einem einen und oder aber nicht kein keine keinen ist sind war waren wird werden wurde wurden für mit von zu zum zur im in am auf aus bei nach über unter vor durch gegen ohne um wie viele was wer wen wem welche welcher welches wo wann warum ich du er sie es wir ihr mich mir dich dir ihn ihm uns euch sich mein dein sein hat haben hatte kann können konnte darf dürfen soll sollen muss müssen will wollen möchte je hier dort dann auch noch nur schon sehr so als wenn weil dass daß ob doch denn alle jede jeder jedes jeden dieser diese dieses meinen bitte leider zwischen deren dessen",
    "fr": "la le les l un une des du de d et ou mais ne pas est sont était étaient pour avec dans sur sous par au aux ce cet cette ces que qui quoi dont où combien quel quelle quels quelles comment quand pourquoi je tu il elle nous vous ils elles me te se mon ma mes ton sa son ses leur leurs notre votre y en si plus moins très aussi comme être avoir ont avait fait faire peut peux pouvez puis suis sans entre chaque tout tous toute toutes même déjà encore ici là voici voilà cela chez vers après avant depuis pendant aucun aucune m n s j c qu",
    "es": "el la los las un una unos unas de del al y o pero no es son era eran para por con en sobre sin según entre hay cuál cuáles cuántos cuántas qué quién quiénes dónde cuándo cómo cuando donde como que cuyo cuya cuyos cuyas sea fue ser está están estar yo tú él ella nosotros ustedes me te se le les lo mi tu su sus nuestro este esta esto estos estas ese esa eso más menos muy también ya si porque desde hasta todo todos toda todas cada aquí puedo puede pueden tengo tiene he ha han",
    "pt": "o a os as um uma uns umas de do da dos das no na nos nas ao à aos às e ou mas não é são era eram para por pelo pela com em sobre sem entre quantos quantas qual quais que quem onde quando como porque cujo cuja cujos cujas seja foi ser está estão estar eu você ele ela nós vocês me te se lhe meu minha seu sua seus suas nosso este esta isto esse essa isso mais menos muito também já só se desde até todo todos toda todas cada aqui posso pode podem tenho tem há",
    "it": "il lo la i gli le un uno una di del della dei delle dello al alla ai alle da dal dalla dalle in nel nella nei con su sul sulla per tra fra e o ma non è sono era erano che chi cui quale quali quanti quante quanto dove quando come perché io tu lui lei noi voi loro mi ti ci vi si me mio tuo suo sua suoi questo questa questi queste quello quella più meno molto anche già solo se ogni tutto tutti tutte ho ha hanno posso può possono essere avere stato ecco qui",
    "pl": "i w we z ze na do od dla po przez przy o u nie jest są był była było były się to ten ta te tego tej tym tych że który która które których ile jaki jaka jakie jak gdzie kiedy dlaczego kto co oraz lub albo ale czy jako ja ty on ona my wy oni mnie mi ci mu jej ich nas nam mój twój jego każdy każda każdego wszystkie także też tylko już bardzo więcej mniej pod nad między bez aby żeby oto jeśli bo mogę może być został została",
    "tr": "ve veya ile için bir bu şu o da de mi mı mu mü ne nasıl nerede nereye kaç hangi kim neden her değil var yok olan olarak gibi daha çok az ama fakat ben sen biz siz onlar bana sana ona bize benim senin onun bizim sonra önce göre kadar bütün tüm hiç ise eğer çünkü ancak sadece üzerinde altında içinde olduğu işte",
    "nl": "de het een van en of maar niet geen is zijn was waren wordt werd voor met in op aan bij uit naar over onder door hoe veel wat wie welke welk waar wanneer waarom ik jij je u hij zij wij we ze me mij mijn jouw ons onze hun haar dit dat deze die er hier daar dan ook nog maar als omdat kan kunnen mag moet wil alle elke zeer tussen zonder",
    "sv": "och eller men inte är var för med av till från på i om under över hur många mycket vad vem vilken vilka var när varför jag du han hon vi ni de mig dig oss min din sin det den detta denna dessa som att så än också bara kan ska vill måste har hade alla varje här där mellan utan",
    "da": "og eller men ikke er var for med af til fra på i om under over hvor mange meget hvad hvem hvilken hvilke hvornår hvorfor jeg du han hun vi de mig dig os min din sin det den dette denne disse som at så også kun kan skal vil må har havde alle hver her der mellem uden",
    "cs": "a i nebo ale ne není je jsou byl byla bylo být v ve z ze na do od pro po přes při o u se si to ten ta ty tento tato který která které kolik jaký jaká jaké jak kde kdy proč kdo co já ty on ona my vy oni mě mi mu její jejich nás nám můj tvůj jeho každý každá všechny také jen už velmi více méně pod nad mezi bez aby zde pokud protože mohu může",
    "ro": "și sau dar nu este sunt era erau pentru cu de din la pe în prin despre fără între câte câți care cine ce unde când cum eu tu el ea noi voi ei mă te se îmi meu mea tău său lui acest această acesta mai foarte și doar fiecare toate toți poate pot trebuie iată",
    "hu": "a az és vagy de nem van volt vannak lesz hogy ha mert mint aki ami amely melyik hány mennyi mi ki hol mikor hogyan én te ő mi ti ők ez azok ezek egy meg már csak is nagyon minden között nélkül kell lehet",
    "fi": "ja tai mutta ei en ole on olivat oli ovat että jos koska kun kuin joka mikä mitä kuka missä milloin miten kuinka monta minä sinä hän me te he tämä tuo se nämä myös vain hyvin kaikki joku",
    "id": "dan atau tetapi tidak bukan adalah ialah untuk dengan dari ke di pada oleh yang ini itu apa siapa mana berapa bagaimana kapan mengapa saya kamu anda dia kami kita mereka sudah akan bisa boleh dapat juga hanya lebih sangat semua setiap antara tanpa karena jika maaf bagi sila tiada ada",
    "vi": "và hoặc nhưng không là có của cho với từ đến trong trên này đó những các một được bị tôi bạn anh chị chúng họ gì nào ai đâu khi bao nhiêu rất cũng chỉ thì mà nếu vì",
}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Fixed: ranges of scripts that name a language, or a family of which one is the usual one.
_SCRIPTS = (
    ("ja", re.compile(r"[぀-ヿ]")),
    ("ko", re.compile(r"[가-힯]")),
    ("zh", re.compile(r"[一-鿿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("he", re.compile(r"[֐-׿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("th", re.compile(r"[฀-๿]")),
)


def _weights() -> dict[str, dict[str, float]]:
    owners: dict[str, list[str]] = {}
    for lang, text in WORDS.items():
        for w in set(text.split()):
            owners.setdefault(w, []).append(lang)
    return {w: dict.fromkeys(langs, 1.0 / len(langs) ** 1.5) for w, langs in owners.items()}


_BASIC = _weights()
#: A learned word counts as much as a function word that it shares with one other language does.
LEARNED = 0.35
#: The fit: labelled documents of a language that are read at most, documents of it a word must be in, how much more
#: often than in any other language, and words kept for a language.
FIT_DOCUMENTS, FIT_LEAST, FIT_LEAD, FIT_WORDS = 5_000, 8, 12.0, 2_000


def fit_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = FIT_DOCUMENTS) -> dict[str, str]:
    """{word: language} of words that tell a language, from labelled documents.

    About `documents` documents of each language are read, those with the smallest hashes of their keys: a bounded
    sample. A word must be written in small letters, which leaves names out, in FIT_LEAST documents
    of its language, and FIT_LEAD times as often, as a share of documents, as in any other language, so that column names and
    wrong labels teach nothing. At most FIT_WORDS words of each language reach the driver.
    Labels that are not two letters, null texts and languages of scripts of their own are left out; no documents teach no words.
    """
    code = F.lower(trimmed(F.col(lang)))
    scripts = [name for name, _ in _SCRIPTS]
    rows = docs.where(F.col(text).isNotNull() & code.rlike("^[a-z]{2}$") & ~code.isin(scripts)).select(code.alias("lang"), F.xxhash64(key).alias("h"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").count()
    share = F.lit(float(documents)) / F.col("count")
    near = rows.join(F.broadcast(sizes), "lang").where((F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)))  # languages have at most 676 codes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(code_, w) for code_, t in zip(pdf.lang, pdf.text) for w in {w for w in _TOKEN.findall(t) if 2 <= len(w) <= 24 and w.islower()}]
            yield pd.DataFrame(out, columns=["lang", "word"])

    counts = near.select("lang", "text").mapInPandas(run, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = near.groupBy("lang").agg(F.count("*").alias("of"))
    rated = counts.join(F.broadcast(total), "lang").withColumn("rate", (F.col("n") + 0.0) / F.col("of"))
    by_word = rated.groupBy("word").agg(F.max(F.struct("rate", "n", "lang")).alias("top"), F.array_sort(F.collect_list("rate")).alias("rates"))  # one rate for a language
    second = F.coalesce(F.try_element_at("rates", F.lit(-2)), F.lit(0.0))
    told = by_word.where((F.col("top.n") >= FIT_LEAST) & (F.col("top.rate") >= FIT_LEAD * second)).select("word", "top.lang", "top.n")
    best = told.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "word")), False), 1, FIT_WORDS).alias("words"))  # words of one language, known by their counts in a bounded sample
    return {w["word"]: r["lang"] for r in best.collect() for w in r["words"]}


def scores(text: str, learned: Mapping[str, str] | None = None) -> dict[str, float]:
    """Evidence for each language with Latin script: the weights of its words in the text."""
    got: dict[str, float] = {"es": 0.7} if re.search("[¿¡]", text) else {}
    for w in _TOKEN.findall(text.lower().replace("’", "'")):
        for part in {w} if w in _BASIC else {w, *w.split("'")}:
            known = _BASIC.get(part)
            if known:
                for lang, weight in known.items():
                    got[lang] = got.get(lang, 0.0) + weight
            elif learned and (lang := learned.get(part)):
                got[lang] = got.get(lang, 0.0) + LEARNED
    return got


def language_of(text: str, learned: Mapping[str, str] | None = None, least: float = 0.8, lead: float = 1.25) -> str | None:
    """Language code, or None if the evidence is weak or two languages are close."""
    for lang, script in _SCRIPTS:
        n = len(script.findall(text))
        if n >= 4 or n >= 2 and n * 4 >= sum(map(str.isalpha, text)):
            return lang
    ranked = sorted(scores(text, learned).items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] < least or len(ranked) > 1 and ranked[0][1] < lead * ranked[1][1]:
        return None
    return ranked[0][0]
