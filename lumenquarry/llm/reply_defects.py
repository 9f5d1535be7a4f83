"""Broken prompt and response pairs (problem 3).

Each defective reply gets one label, the first that fits of: empty, question_copy, refusal,
other_language, truncated.

* Copies: the reply is compressed with its question as a zstandard dictionary, and the
  question with the reply. A copy adds next to nothing to the question and leaves next to
  nothing of it.
* Refusals and languages: dictionaries of general words and phrases, and scripts.
* Truncation: terminal-context models counted over all replies. Replies become templates
  (words that stand in short replies too are slots, numbers as well); a reply is
  cut off where its template nearly always goes on, where its last word nearly never ends a
  reply, or where its last word is the beginning of the word that is known to follow.

What a reply's ending says is a yes or no for each of three keys (template, last word, last two
words). The MODEL_KEYS keys that end most replies are in every task; replies that end in a rarer
key are joined with the table of bad endings. Either way gives the same rows, and a key
outside the model is rare, so the join has no hot key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

DEFECTS = ("empty", "question_copy", "refusal", "other_language", "truncated")

#: A template that ends a reply in at most this share of its cases, seen so often, is no ending; the same for a word.
TEMPLATE_SEEN, TEMPLATE_ENDS, WORD_SEEN, WORD_ENDS = 8, 0.15, 50, 0.02
#: Longer words that must follow the same word, where the reply's last one is their beginning; and how
#: many times more often than the last one itself, once that is seen more than twice.
LONGER_SEEN, LONGER_TIMES = 3, 5
#: A word is a slot if so large a share of it stands in replies of at most SHORT words.
SLOT_SHARE, SHORT = 0.1, 3
#: The slots are held as a filter of SLOT_BITS bits a word, but at most 2 ** SLOT_MOST bits (128 MB, full
#: at 32 million slots; beyond, more other words pass for slots).
SLOT_BITS, SLOT_LEAST, SLOT_MOST = 32, 16, 30
#: Keys of endings that every task holds (9 bytes each).
MODEL_KEYS = 1_000_000
#: Copies: bytes that a reply may add to the question, and the share of the question it may leave out.
ADDS_BYTES, ADDS_SHARE, LEAVES_SHARE = 12, 0.15, 0.4

TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")

# Fillers for a missing value, in bare form ("none" is an answer).
FILLERS = frozenset(
    "na nan null nil tbd todo missing noanswer noresponse nodata notavailable notapplicable notprovided notspecified unanswered undefined "
    "unspecified blank empty keineangabe keineantwort sinrespuesta sindatos sansréponse nonrenseigné nessunarisposta semresposta "
    "geenantwoord brakodpowiedzi 暂无 缺失 未填写 无数据 未知".split()
)

# Phrases that decline, matched in the words of a reply joined by single spaces.
_DECLINED = (
    "answer|help|assist|assess|give|provide|offer|comment|judge|say|respond|interpret|diagnose|determine|tell|discuss|speculate|"
    "advise|disclose|fulfil|fulfill|comply|engage|share|address|complete|process|do (?:that|this|so)|be of help"
)
REFUSALS = re.compile(
    r"\b(?:"
    # regret
    r"(?:i|we) (?:am |m |are |re |feel )?(?:so |very |truly |really |terribly |deeply )?sorry|^(?:so |very )?sorry|sorry (?:but|i|we|to say)|"
    r"(?:i|we) (?:do |must )?apologi[sz]e|(?:my|our) apologies|(?:i|we) regret|unfortunately (?:i|we|that is something|this is something|it is not possible)|"
    # the act itself
    r"abstain\w*|abstention|declin(?:e|es|ed|ing) to (?:\w+ )?(?:answer|respond|comment|say)|(?:i|we|must|have to) (?:\w+ )?(?:decline|refrain|refuse)|"
    r"refus(?:e|es|ed|ing) to (?:answer|respond|comment|say)|(?:answer|response|comment) (?:is )?(?:declined|refused|withheld)|no comment|"
    r"(?:(?:would|d) (?:rather|prefer)|prefer|(?:would|d) rather prefer|choose|have decided|(?:would|d) like) not(?: to)?|rather not (?:say|answer|comment)|"
    # inability
    rf"(?:can ?not|can t|could not|couldn t|unable to|not able to|won t|will not|wouldn t|would not|must not|mustn t|may not|shall not) (?:\w+ly )?(?:{_DECLINED}|be (?:answering|commenting|discussing)|make (?:that|this|such|any))|impossible for (?:me|us) to|"
    r"(?:not|isn t|m not|am not|are not) (?:really )?(?:in a|in any) position to|(?:i|we) (?:don t|do not) (?:provide|offer|give|answer|comment|discuss|feel comfortable)|"
    r"(?:i|we) (?:\w+ )?(?:don t|do not|didn t) know|(?:i|we) have no idea|not (?:something|a question) (?:i|we) (?:can|could|am|m|will)|"
    r"(?:not|isn t) (?:possible|feasible) (?:for (?:me|us) )?to (?:answer|say|tell|determine|give)|"
    # limits
    r"(?:my|our) (?:guidelines|guideline|policy|policies|instructions|programming|training) (?:\w+ )?(?:prevent|forbid|prohibit|don t|do not|does not)\w*|"
    r"(?:against|violates?) (?:my|our) (?:guidelines|policy|policies|rules)|as an? (?:automated|ai|artificial|language|large|virtual|digital)|"
    r"(?:not be|is not|isn t|would be in)\s?(?:appropriate|proper|right) for (?:me|us)|inappropriate for (?:me|us)|"
    r"(?:outside|beyond|exceeds|above|not within|out of) (?:of |the )?(?:what (?:i|we)|(?:scope|limits|realm) of (?:my|our|what)|my|our) ?\w*|"
    r"(?:not|am not|m not|are not|re not) (?:allowed|permitted|authori[sz]ed|qualified|licensed|equipped|competent) to|"
    r"no (?:\w+ )?answer (?:is available|can be|could be|possible)|insufficient evidence|evidence insufficient|"
    r"(?:insufficient|not enough|too little|inadequate) (?:information|data|context|detail) (?:to|is|was|for|available)|consult (?:a|your) (?:doctor|physician|specialist|professional)|"
    # other languages
    r"leider|tut mir leid|entschuldigung|kann ich (?:\w+ )?nicht|ich (?:kann|darf|möchte|will) (?:\w+ ){0,3}(?:nicht|keine|nichts)|(?:möchte|will|kann|darf) ich (?:\w+ )?nichts|keine auskunft|"
    r"désolée?|navrée?|je (?:ne|n) (?:peux|puis|sais|suis pas|souhaite)|(?:je|nous) (?:refuse|refusons|préfère ne)|impossible de (?:répondre|dire|donner)|ne puis répondre|"
    r"lo siento|lamento|disculpe|(?:no|tampoco) (?:lo )?(?:puedo|podemos|sé|sabría)|no (?:me )?es posible (?:responder|decir|dar)?|no estoy en condiciones|prefiero no|"
    r"mi dispiace|spiacente|non (?:lo )?(?:posso|so|sono in grado)|preferisco non|desculpe|lamento|não (?:posso|sei|consigo)|prefiro não|"
    r"helaas|het spijt me|(?:kan|mag|wil) ik (?:\w+ )?niet|ik (?:kan|mag|weet) (?:\w+ ){0,2}niet|"
    r"przykro mi|przepraszam|nie (?:mogę|wiem|jestem w stanie)|bohužel|nemohu|nevím|tyvärr|beklager|desværre|jag kan inte|jeg kan ikke|"
    r"sajnálom|nem tudok|îmi pare rău|nu pot|üzgünüm|maalesef|valitettavasti|en voi|"
    r"к сожалению|извините|не могу|не можем|не знаю|на жаль"
    r")\b"
)
REFUSALS_HAN = re.compile(
    "抱歉|对不起|很遗憾|恕(?:我|不)|无法(?:回答|提供|判断|评估|给出|作答|确定|回应)|不能(?:回答|提供|评论|给出|作答|回应)|拒绝|不便(?:回答|评论|透露)|不予|"
    "我不(?:知道|清楚|会回答)|申し訳|お答えでき|わかりません|죄송|수없습니다|모르겠"
)

# General words by which a language is known (articles, pronouns, prepositions, auxiliaries, yes and no, places).
LANGUAGES = {
    "en": "the of and is it in to with a an that this there was were are no not none for on at by as or both from but yes has have had be been "
    "its which who what where when than then into over under all some any left right upper lower above below near beside between behind about "
    "os op can may will would could should do does did shows show looks seems appears contains more less very without within i we you he she they my your",
    "de": "der die das den dem des ein eine einen einem einer eines ist sind war und oder nicht kein keine keinen keiner mit im am an auf bei aus von vom zu "
    "zum zur ja nein neben unter über zwischen hinter vor oben unten rechts links linken linke rechten rechte es er sie man auch nur sehr ohne durch für "
    "nach wird wurde kann hat haben sich wie als aber etwa hier dort sieht zeigt liegt kleine kleiner kleines große großer",
    "fr": "le la les un une des du de et c qu j n est sont il elle on ce cet cette ces dans sur sous avec sans à au aux en oui non pas ne ni par pour qui que "
    "près côté gauche droite droit entre chez plus très aussi mais ou rien aucun aucune voit montre son sa ses leur été fait petit petite grand grande",
    "es": "el la los las un una unos unas de del y o es son está están en con sin no sí al se lo su sus por para que como pero muy más junto cerca sobre "
    "bajo entre hay ve ningún ninguna nada izquierda izquierdo derecha derecho arriba abajo esto este esta fue ser pequeño pequeña grande",
    "it": "il lo la gli le un una uno di del della dei delle e è sono in con senza non sì al alla sul sulla nel nella per che come ma molto più "
    "vicino sopra sotto tra c sinistra sinistro destra destro nessun nessuna questo questa si vede piccolo piccola anche",
    "pt": "o os as um uma de do da dos das e é são em no na nos nas com sem não sim ao à por para que como mas muito mais perto sobre entre há "
    "esquerda esquerdo direita direito acima abaixo nenhum nenhuma isto este esta foi pequeno pequena também",
    "nl": "de het een van en of is zijn niet geen met op in aan bij uit voor naar door ook maar ja nee onder boven naast tussen achter links rechts "
    "linker rechter dit dat deze er wordt werd kan heeft zeer zonder hier kleine",
    "pl": "i w we z ze na do od po pod nad przy przez dla o nie tak jest są był było się to ten ta te jak ale lub oraz bez lewej lewy lewa prawej prawy "
    "prawa bardzo tylko brak widać mały mała obok między",
    "cs": "je jsou v ve z ze na do od po pod nad při pro o ne ano není jsou se to ten ta jak ale nebo bez vlevo vpravo levé pravé velmi jen malý malá vedle mezi",
    "sv": "och det en ett i på av är var som med för till inte ingen inga utan från vid under över mellan ja nej vänster höger men eller mycket liten den de",
    "da": "og det en et i på af er var som med for til ikke ingen uden fra ved under over mellem ja nej venstre højre men eller meget lille den de",
    "ro": "și este sunt un o în la cu fără nu da de din pe pentru care ca dar sau foarte stânga dreapta sub peste între lângă mic mică se vede",
    "hu": "a az egy és van nem igen nincs is hogy de vagy bal jobb alatt felett mellett között nagyon kis ez látható",
    "tr": "bir ve bu şu ile için değil var yok evet hayır sol sağ altında üstünde yanında arasında çok küçük olan da de",
    "fi": "on ei ja se tämä joka oli ovat kyllä vasen vasemmalla oikea oikealla alla yllä vieressä välissä hyvin pieni mutta tai ilman",
}
LANGUAGES = {k: frozenset(v.split()) for k, v in LANGUAGES.items()}
#: Letters that English words lack, but for the loanwords and names that keep them.
ACCENTS = re.compile("[äöüßéèêëàâîïôûùçñáíóúœæøåãõìòąćęłńśźżěščřžýůőűășțğışİ]")
ENGLISH_ACCENTED = frozenset("ménière ménétrier sjögren barré schönlein müller köhler lövei café naïve façade résumé cliché fiancé rené".split())
SCRIPTS = {
    "han": re.compile("[㐀-鿿]"),
    "kana": re.compile("[぀-ヿ]"),
    "hangul": re.compile("[가-힣]"),
    "cyrillic": re.compile("[Ѐ-ӿ]"),
    "arabic": re.compile("[؀-ۿ]"),
    "hebrew": re.compile("[֐-׿]"),
    "greek": re.compile("[Ͱ-Ͽ]"),
    "thai": re.compile("[฀-๿]"),
    "devanagari": re.compile("[ऀ-ॿ]"),
    "latin": re.compile("[a-zà-ɏ]"),
}


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if isinstance(text, str) else []


def script_of(text: str) -> str:
    """Han counts double, as a sign is a word; '' without letters."""
    if text.isascii():
        return "latin" if SCRIPTS["latin"].search(text) else ""
    n = {k: len(p.findall(text)) * (3 if k == "han" else 1) for k, p in SCRIPTS.items()}
    best = max(n, key=n.get)
    return best if n[best] else ""


def asked_in(question: str, asked: list[str]) -> tuple[bool, str, str]:
    """Whether the question has Han signs, its script and its language: all that has_other_language takes from it."""
    q = question.lower()
    own = max(LANGUAGES, key=lambda k: (sum(w in LANGUAGES[k] for w in asked), k == "en"))
    return bool(SCRIPTS["han"].search(q)), script_of(q), own


def has_other_language(asked: tuple[bool, str, str], words: list[str], reply: str) -> bool:
    a = reply.lower()
    asked_han, asked_script, own = asked
    script = script_of(a)
    if not script:
        return False
    if script != "latin" or asked_han:
        if asked_han:
            return not SCRIPTS["han"].search(a) and sum(len(w) for w in words if not w.isdigit()) > 3
        return bool(asked_script) and script != asked_script
    if asked_script and asked_script != "latin":
        return sum(len(w) for w in words if not w.isdigit()) > 3
    score = {k: sum(w in v for w in words) for k, v in LANGUAGES.items()}
    best = max((k for k in LANGUAGES if k != own), key=lambda k: score[k])
    accented = own == "en" and not a.isascii() and any(ACCENTS.search(w) and w not in ENGLISH_ACCENTED for w in words)
    return score[best] + accented > score[own] and (score[best] >= 2 or accented or score[best] >= 0.5 * len(words))


def is_copy(asked: bytes, said: bytes) -> bool:
    """Whether the words of a reply are those of its question and next to nothing else."""
    import zstandard

    if len(asked) < 8 or len(said) < 0.5 * len(asked):
        return False
    if asked == said:
        return True

    def size(text: bytes, given: bytes) -> int:
        d = zstandard.ZstdCompressionDict(given, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(text))

    adds = size(said, asked)
    alone = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(asked))
    return adds <= ADDS_BYTES + ADDS_SHARE * alone and size(asked, said) <= ADDS_BYTES + LEAVES_SHARE * alone


class Slots:
    """A set of words as a filter: each sets three of the 64 bits of a cell."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.known = cells, {}

    @staticmethod
    def place(word: str, cells: int) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(word, 3)
        return (h >> 18) % cells, 1 << (h & 63) | 1 << (h >> 6 & 63) | 1 << (h >> 12 & 63)

    def __contains__(self, word: str) -> bool:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            at, bits = self.place(word, len(self.cells))
            found = self.known[word] = int(self.cells[at]) & bits == bits
        return found

    def __reduce__(self):
        return Slots, (self.cells,)


def _slots(words: DataFrame) -> Slots:
    """The filter of the column ``b``."""
    bits = min(max((words.count() * SLOT_BITS).bit_length(), SLOT_LEAST), SLOT_MOST)
    cells = 1 << (bits - 6)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = [Slots.place(w, cells) for w in pdf.b]
            yield pd.DataFrame({"cell": [a for a, _ in at], "bits": [_signed(m) for _, m in at]}, dtype="int64")

    found = words.select("b").mapInPandas(places, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(cells, np.int64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return Slots(out.view(np.uint64))


def template(words: list[str], slots) -> list[str]:
    """The words with slots and numbers as signs, slots in a row as one."""
    out: list[str] = []
    for w in words:
        t = "0" if w.isdigit() else "_" if w in slots and not SCRIPTS["han"].match(w) else w
        if not (t == "_" and out and out[-1] == "_"):
            out.append(t)
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def contexts(signs: list[str]) -> Iterator[int]:
    """A key for each beginning of a template, the whole one last."""
    h = 0
    for t in signs:
        h = xxhash.xxh3_64_intdigest(t, h)
        yield _signed(h)


def word_key(word: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(word, 1))


def pair_key(before: str, last: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(f"{before}\x1f{last}", 2))


def ending_keys(words: list[str], slots) -> list[int]:
    """What a reply's ending is known by: its template, its last word, its last two words (a
    number of more than one digit is no cut-off word)."""
    *_, whole = contexts(template(words, slots))
    last = words[-1]
    keys = [whole, word_key(last)]
    if not (len(last) > 1 and last.isdigit()):
        keys.append(pair_key(words[-2] if len(words) > 1 else "\x02", last))
    return keys


def replies(samples: DataFrame, results: DataFrame) -> DataFrame:
    """record_kind, record_key, question, reply of both tables; rows without a key are left out."""
    return (
        samples.select(F.lit("sample").alias("record_kind"), F.col("sample_id").alias("record_key"), "question", F.col("answer").alias("reply"))
        .unionByName(
            results.select(F.lit("result").alias("record_kind"), F.col("result_id").cast("string").alias("record_key"), "question", F.col("prediction").alias("reply"))
        )
        .filter(F.col("record_key").isNotNull())
    )


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words (a is '') and pairs of words in a row: uses, endings and uses in short replies."""
    uses, ends, short = Counter(), Counter(), Counter()

    def settle() -> pd.DataFrame:
        out = [(*p, n, ends[p], short[p]) for p, n in uses.items()]
        for c in (uses, ends, short):
            c.clear()
        return pd.DataFrame(out, columns=["a", "b", "n", "ends", "short"])

    for pdf in batches:
        for reply, n in pdf.reply.value_counts().items():
            w = tokens(reply)
            if not w:
                continue
            for x in w:
                uses["", x] += n
            for p in zip(["\x02", *w], w):
                uses[p] += n
            ends["", w[-1]] += n
            ends[w[-2] if len(w) > 1 else "\x02", w[-1]] += n
            if len(w) <= SHORT:
                for x in w:
                    short["", x] += n
            if len(uses) > 500_000:
                yield settle()
    yield settle()


def _count_contexts(slots):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = slots.value
        passed, ended = Counter(), Counter()

        def settle() -> pd.DataFrame:
            out = pd.DataFrame({"context": list(passed), "passed": list(passed.values()), "ended": [ended[c] for c in passed]}, dtype="int64")
            passed.clear()
            ended.clear()
            return out

        for pdf in batches:
            for reply, n in pdf.reply.value_counts().items():
                last = None
                for last in contexts(template(tokens(reply), known)):
                    passed[last] += n
                if last is not None:
                    ended[last] += n
                if len(passed) > 500_000:
                    yield settle()
        yield settle()

    return rows


def _word_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"key": [pair_key(a, b) if a else word_key(b) for a, b in zip(pdf.a, pdf.b)], "ended": pdf.ended, "bad": pdf.bad}).astype({"key": "int64"})


def endings(pairs: DataFrame) -> tuple[Slots, DataFrame]:
    """The words that are slots, and the table key, ended, bad of all keys that end
    a reply: how many they end, and whether that is no place to end."""
    spark = pairs.sparkSession
    reply = pairs.select("reply").filter("reply IS NOT NULL")
    counted = cut(
        reply.mapInPandas(_count_words, "a string, b string, n long, ends long, short long")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("short").alias("short"))
    )
    words, follow = counted.filter("a = ''"), counted.filter("a <> ''")
    slots = _slots(words.filter(F.col("short") >= SLOT_SHARE * F.col("n")))
    found = (
        reply.mapInPandas(_count_contexts(spark.sparkContext.broadcast(slots)), "context long, passed long, ended long")
        .groupBy("context")
        .agg(F.sum("passed").alias("passed"), F.sum("ended").alias("ended"))
        .filter("ended > 0")
        .select(F.col("context").alias("key"), "ended", ((F.col("passed") >= TEMPLATE_SEEN) & (F.col("ended") <= TEMPLATE_ENDS * F.col("passed"))).alias("bad"))
    )
    longer = (
        follow.filter((F.col("n") >= LONGER_SEEN) & (F.length("b") > 1))
        .select("a", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("b") - 1), lambda i: F.left("b", i))).alias("b"))
        .groupBy("a", "b")
        .agg(F.max("n").alias("longer"))
    )
    enough = F.when(F.col("n") <= 2, LONGER_SEEN).otherwise(LONGER_TIMES * F.col("n"))
    of_pairs = follow.filter("ends > 0").join(longer, ["a", "b"], "left").select("a", "b", F.col("ends").alias("ended"), (F.coalesce("longer", F.lit(0)) >= enough).alias("bad"))
    of_words = words.filter("ends > 0").select("a", "b", F.col("ends").alias("ended"), ((F.col("n") >= WORD_SEEN) & (F.col("ends") <= WORD_ENDS * F.col("n"))).alias("bad"))
    return slots, cut(found.unionByName(of_words.unionByName(of_pairs).mapInPandas(_word_keys, "key long, ended long, bad boolean")))


def _model(keys: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The at most ``most`` keys that end most replies with their verdicts, sorted, and whether these are all."""
    sizes = keys.groupBy(F.floor(F.log2("ended")).alias("s")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    least, room = 64, most
    for r in sorted(sizes, key=lambda r: -r.s):
        room -= r.n
        if room < 0:
            break
        least = r.s
    held = keys.filter(F.floor(F.log2("ended")) >= least).select("key", "bad").toArrow()
    key = held["key"].to_numpy()
    order = np.argsort(key)
    return key[order], held["bad"].to_numpy()[order].astype(bool), room >= 0


class Judge:
    """Verdicts on pairs. What follows from a question or from a reply alone is kept for the
    next rows; both are functions of the text, so the order of the rows changes nothing."""

    def __init__(self, slots):
        self.slots, self.asked, self.said = slots, {}, {}

    def question(self, text: str | None):
        found = self.asked.get(text)
        if found is None:
            if len(self.asked) > 100_000:
                self.asked.clear()
            words = tokens(text)
            found = self.asked[text] = (" ".join(words).encode(), asked_in(text, words) if words else None)
        return found

    def reply(self, text: str | None):
        """Words, their bytes, a label that needs no question, and the keys of the ending."""
        found = self.said.get(text)
        if found is None:
            if len(self.said) > 100_000:
                self.said.clear()
            words = tokens(text)
            bare, joined = "".join(words), " ".join(words)
            if not bare or bare in FILLERS:
                found = words, b"", "empty", []
            else:
                declined = REFUSALS.search(joined) or REFUSALS_HAN.search(bare)
                found = words, joined.encode(), "refusal" if declined else None, ending_keys(words, self.slots)
            self.said[text] = found
        return found

    def __call__(self, question: str | None, reply: str | None) -> tuple[str | None, list[int]]:
        """The defect, or None and the keys that tell whether the reply is cut off."""
        words, said, label, keys = self.reply(reply)
        if label == "empty":
            return label, keys
        asked, language = self.question(question)
        if is_copy(asked, said):
            return "question_copy", keys
        if label:
            return label, keys
        if language and has_other_language(language, words, reply):
            return "other_language", keys
        return None, keys


def _judged(slots, model):
    """Rows with a defect, and rows without one for each key of their ending that the model lacks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, (known, bad) = Judge(slots.value), model.value
        for pdf in batches:
            question, reply = pdf.question.where(pdf.question.notna(), None), pdf.reply.where(pdf.reply.notna(), None)
            found = [judge(q, r) for q, r in zip(question, reply)]
            label = np.array([d for d, _ in found], object)
            open_ = [i for i, (d, _) in enumerate(found) if d is None]
            row = np.repeat(open_, [len(found[i][1]) for i in open_]).astype(np.int64)
            key = np.array([k for i in open_ for k in found[i][1]], np.int64)
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            inside = known[at] == key if len(known) else np.zeros(len(key), bool)
            cut_off = np.zeros(len(pdf), bool)
            cut_off[row[inside][bad[at[inside]]]] = True
            label[cut_off] = "truncated"
            rest = ~inside & ~cut_off[row]
            done = np.flatnonzero(pd.notna(label))
            take = np.concatenate([done, row[rest]])
            yield pd.DataFrame(
                {
                    "record_kind": pdf.record_kind.to_numpy()[take],
                    "record_key": pdf.record_key.to_numpy()[take],
                    "defect": label[take],
                    "key": np.concatenate([np.zeros(len(done), np.int64), key[rest]]),
                }
            )

    return rows


def defects(pairs: DataFrame, model_keys: int = MODEL_KEYS) -> DataFrame:
    """record_kind, record_key, defect of every defective reply, once however often it was
    delivered. A null reply is empty; with a null question only empty, refusal and truncated
    can be told. A key delivered with contradicting texts gets the first defect in the order
    of the labels. ``model_keys`` bounds what a task holds and changes no row."""
    context = pairs.sparkSession.sparkContext
    slots, keys = endings(pairs)
    known, bad, all_ = _model(keys, model_keys)
    found = pairs.mapInPandas(
        _judged(context.broadcast(slots), context.broadcast((known, bad))), "record_kind string, record_key string, defect string, key long"
    )
    if not all_:
        found = cut(found)
        rare = found.filter("defect IS NULL").join(keys.filter("bad").select("key").hint("merge"), "key", "left_semi")
        found = found.filter("defect IS NOT NULL").unionByName(rare.withColumn("defect", F.lit("truncated")), allowMissingColumns=True)
    order = F.array_position(F.lit(list(DEFECTS)), F.col("defect"))
    return found.groupBy("record_kind", "record_key").agg(F.min_by("defect", order).alias("defect"))


def report(pairs: DataFrame) -> DataFrame:
    """record_kind, defect, n_records."""
    return defects(pairs).groupBy("record_kind", "defect").agg(F.count("*").alias("n_records"))
