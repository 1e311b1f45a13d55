r"""PII surrogates: every detected entity is replaced by another of its kind, the same one everywhere.

Found are e-mail addresses, telephone, card and social security numbers, IP addresses, IBANs, hexadecimal
and prefixed secrets, and personal names: given names of a table that is apart from the surrogates (`names.py`),
with the capitalised words, initials and particles after them, capitalised words after a title or a few
phrases, and surnames found so wherever else they stand in the text. Mentions that differ in case or in how numbers are grouped are one entity: telephone
numbers by their last ten digits, so one with a country code and one without stay the same person's where
the number itself has ten. National telephone numbers begin with 0 or are grouped 3-3-4. An IPv6 address
is replaced by one written in full. In e-mail addresses a letter becomes another of its script, or a Latin
one if the script has no list.

A surrogate is drawn from a keyed hash of the entity. Numbers keep length and grouping, cards their first
digit and a valid check digit where they had one, e-mail addresses of one domain stay together under
another, secrets keep length, alphabet and prefix, names keep gender, script and case. Entities whose
surrogates meet, or whose surrogate is itself somebody's original, draw again, all but the one with the
fewest draws and then the smallest text, until all are distinct; so equal stays equal, different stays
different, and no surrogate points to another person of the corpus.

All of it is DataFrame expressions. Different texts that hold entities are taken once, whatever their
number of copies; of a mention only text digest and position travel. Texts with entities are written aside and
meet their replacements by digest at the end; texts without are read once more and never move.

Defined results: null is an empty text; texts without entities stay as they are; repeated rows get equal
texts; added columns replace others of their names; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.llm import frames, names

KEY = "change me"
ROUNDS = 40

# fixed values: given names by gender and script
GIVEN = {
    ("f", "latin"): "Mary Patricia Jennifer Elizabeth Barbara Susan Jessica Margaret Sophie Katharina Lucía Camille",
    ("m", "latin"): "James Robert Michael William David Joseph Charles Thomas Jürgen Wolfgang Javier François",
    ("f", "cyrillic"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Людмила",
    ("m", "cyrillic"): "Иван Алексей Сергей Дмитрий Михаил Николай Владимир Андрей Павел Юрий",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Δήμητρα Βασιλική Ιωάννα",
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Παναγιώτης Βασίλης Χρήστος Αντώνης",
}
# fixed values: beginnings and ends that make surnames of each script
SURNAMES = {
    "latin": (
        "Ash Brad Carl Dal East Fair Gard Hart Kings Lang Mar Nor Oak Pres Rad Stan Thorn Wal West Whit",
        "bury combe den field ford ham hurst ley low man mere mond more ridge stead ton well wick wood worth",
    ),
    "cyrillic": (
        "Бор Вол Гор Дан Ер Жук Зим Кал Лук Мор Ник Орл Пет Род Сок Тих Фад Чер Шил Щерб",
        "алёв анин атов енко еев ерин ивцев ищев ков ников овский онин ский ушин цов шаков юков ягин якин янов",
    ),
    "greek": (
        "Αθαν Βλαχ Γεωρ Δημ Ευθ Ζαχ Θεοδ Ιωανν Καρ Λαμπ Μακρ Νικ Οικον Παπ Ραπτ Σταμ Τσακ Φωτ Χατζ Ψαρ",
        "άκης άκος αίος ακάκης άλης ανίδης άρας άτος έας ίδης ίκας ιάδης ίτης όγλου όπουλος ούδης ούλας ουλάκης ώνης ωνάς",
    ),
}
# fixed values: what stands before a name
TITLES = "Mr Mrs Ms Miss Dr Sir Lady Herr Frau Monsieur Madame Mme Señor Señora Sra Господин Госпожа Κύριος Κυρία"

ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "han": "安百北本长春大东多方飞风福刚高光国海和红花华江金静军开康兰乐立林龙美明木南宁平奇青清秋山生石水松天田文武西祥小晓新星雪阳叶义英永友雨玉元月云正志中竹子",
    "hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "hangul": "가강경고광국권기길나남노다단대도동라래로루마명모무문미민바배백보부빈사산상서석선성소송수순승시신아안양영오용우원유은이인일장재정조종주준지진차창철초태하한해현형호홍화효희",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "devanagari": "अआइउकखगघचछजटठडतथदधनपफबभमयरलवशसह",
    "bengali": "অআইউকখগঘচছজটঠডতথদধনপফবভমযরলশসহ",
    "tamil": "அஆஇஉகஙசஞடணதநபமயரலவழளன",
    "thai": "กขคงจฉชซญดตถทธนบปผพฟภมยรลวสหอ",
    "georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ",
}

_GAP = r"[^\p{L}\p{N}\n]{1,6}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PART = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}{1,24}(?:\p{Lu}\p{Ll}{1,24})?"


def _any_of(words: list[str]) -> str:
    """One of these words, tried letter by letter."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            by_first.setdefault(w[0], []).append(w[1:])
    each = "|".join(c + (_any_of(rest) if any(rest) else "") for c, rest in by_first.items())
    return f"(?:{each})" + ("?" if "" in words else "")


_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_ALONE = [*(n for given in GIVEN.values() for n in given.split()), *(n for t in names.TABLE.values() for n in t.split())]
_FIRST = [n for t in names.BEFORE_A_NAME.values() for n in t.split()]
_NAME = rf"(?!{_any_of(names.OTHERS.split())}{_AFTER}){_PART}(?:-{_PART})?"
# up to three more words, with initials and particles before them
_MORE = rf"(?: \p{{Lu}}\.)?(?: {_any_of(names.PARTICLES.split())}){{0,2}} {_NAME}"
_UPPER_MORE = r"(?: \p{Lu}{2,25}(?! \p{Lu}{2}))"


# What an entity is: the first that fits at a place. Parts without an upper bound are of one class of
# characters and begin where no such run is under way, so that each is read once.
EMAIL = {
    "email": r"(?<![\p{L}\p{N}\p{M}][._%+-]{0,16})[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*+"
    r"@[\p{L}\p{N}][\p{L}\p{M}\p{N}.-]*\.(?:xn--[0-9A-Za-z-]*[0-9A-Za-z]|\p{L}[\p{L}\p{M}]+)"
}
_HEX4 = "[0-9a-fA-F]{1,4}"
IP6 = {
    "ip6": rf"(?=[a-fA-F:]*\d)(?:(?:{_HEX4}:){{7}}{_HEX4}|{_HEX4}(?::{_HEX4}){{0,6}}::(?:{_HEX4}(?::{_HEX4}){{0,5}})?)(?!:)",
}
# a national number begins with 0 and has nine to thirteen digits; a date is none
_NATIONAL = (
    r"(?<!\d[-/.:])(?=\(?(?:\d[ )/.-]{0,3}){9,13}(?![\p{L}\p{N}]))(?!\d\d[-/. ]\d\d[-/. ]\d{4}(?!\d))"
    r"(?:\(0\d{1,5}\)|0\d{1,5})[ /.-]{1,3}\d{2,9}(?:[ .-]\d{2,9}){0,4}|0[1-9]\d{7,10}"
)
NUMBERS = {
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": rf"(?:\+\d{{1,3}}{_GAP})?\(?\d{{3}}{_GAP}\d{{3}}{_GAP}\d{{4}}|\+\d{{1,3}}(?:{_GAP}\d{{2,9}}){{2,5}}|\+\d{{8,15}}|{_NATIONAL}",
    "card": r"\d{4}(?:[ -]\d{4}){3}|\d{13,19}",
}
KEYS = {
    "hex": r"[0-9a-fA-F]{32,}+",
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|github_pat_[0-9A-Za-z_]{22,}+"
    r"|sk-[0-9A-Za-z_-]{20,}+|xox[abeprs]-[0-9A-Za-z-]{10,}+",
    "iban": r"[A-Z]{2}\d{2}[0-9A-Z]{11,30}|(?=[A-Z]{2}(?:[A-Z ]{0,9}\d){8})[A-Z]{2}\d{2}(?: [0-9A-Z]{4}){2,7}(?: \d[0-9A-Z]{0,2})?",
}
NAMES = {
    "name": rf"{_any_of(TITLES.split())}\.? {_NAME}(?:{_MORE}){{0,3}}"
    rf"|{_any_of(_ALONE)}(?:-{_PART})?(?:{_MORE}){{0,3}}|{_any_of(_FIRST)}(?:{_MORE}){{1,3}}"
    rf"|{_any_of([n.upper() for n in _ALONE])}{_UPPER_MORE}?|{_any_of([n.upper() for n in _FIRST])}{_UPPER_MORE}"
    rf"|(?:(?<=(?:name is|named) )|(?<=(?:Dear|signed|written by) )(?={_PART} {_PART})){_NAME}(?:{_MORE}){{0,3}}"
}


def _pattern(*groups: tuple[str, dict[str, str]]) -> str:
    """Any of these kinds. The look at the first character comes first, as it is cheap and mostly fails."""
    parts = (f"(?={first}){_BEFORE}(?:{'|'.join(kinds.values())})" for first, kinds in groups)
    return f"(?:{'|'.join(parts)}){_AFTER}"


_NUMBERS, _KEYS, _NAMES = (r"[0-9+(]", NUMBERS), (r"[0-9A-Fa-fgsxA-Z]", KEYS), (r"\p{Lu}", NAMES)
_IP6 = (r"[0-9A-Fa-f]", IP6)
WITH_AT = _pattern((r"[\p{L}\p{N}]", EMAIL), _IP6, _NUMBERS, _KEYS, _NAMES)
WITH_DIGITS = _pattern(_IP6, _NUMBERS, _KEYS, _NAMES)
WITH_CAPITALS = _pattern((_KEYS[0], {k: v for k, v in KEYS.items() if k != "iban"}), _NAMES)


def _by_pattern(text: Column, use) -> Column:
    """What `use` makes of a text with the pattern for it. Texts without an @ hold no address, those
    without digits no numbers; the shorter patterns find the same in them."""
    return (
        F.when(F.contains(text, F.lit("@")), use(WITH_AT))
        .when(text.rlike("[0-9]"), use(WITH_DIGITS))
        .otherwise(use(WITH_CAPITALS))
    )


def _kind(value: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed((EMAIL | IP6 | NUMBERS | KEYS).items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _script(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _normal(kind: Column, value: Column) -> Column:
    """The text that all mentions of an entity share."""
    digits = _digits(value)
    groups = lambda n: F.filter(F.split(F.substring_index(value, "::", n), ":"), lambda g: g != "")
    left, right = groups(1), F.when(F.contains(value, F.lit("::")), groups(-1)).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    ip6 = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")
    return (
        F.when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "secret", value)
        .when(kind == "iban", F.lower(F.replace(value, F.lit(" "), F.lit(""))))
        .when(kind == "ip6", F.lower(ip6))
        .otherwise(F.lower(value))
    )


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _pick(choices: str | list[str], n: Column) -> Column:
    """The choice of number n, counted round."""
    if isinstance(choices, list):
        return F.element_at(F.array(*map(F.lit, choices)), (n % len(choices) + 1).cast("int"))
    return F.substr(F.lit(choices), (n % len(choices) + 1).cast("int"), F.lit(1))


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten for a number with a valid check digit."""
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    each = F.transform(_chars(F.reverse(digits)), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _draw(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, draw) with the surrogate of that draw."""
    seed = F.concat_ws("\0", F.lit(key), "kind", "normal", F.col("draw").cast("string"))
    stream = F.concat(*(F.sha2(F.concat(seed, F.lit(f"\0{i}")).cast("binary"), 256) for i in range(4)))
    drawn = entities.withColumn("stream", stream).withColumn("chars", _chars(F.col("normal")))
    byte = lambda i: F.conv(F.substr("stream", 2 * (i % 128) + 1, F.lit(2)), 16, 10).cast("int")
    digit = lambda i: _pick("0123456789", byte(i))

    def same_class(c: Column, i: Column, hexadecimal: bool = False) -> Column:
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", byte(i))).otherwise(c)
        out = F.when(c.rlike(r"\p{Nd}"), digit(i))
        for script, letters in ALPHABETS.items():
            in_script = c.rlike(rf"\p{{Is{script.capitalize()}}}")
            out = out.when(in_script & (c == F.upper(c)), F.upper(_pick(letters, byte(i))))
            out = out.when(in_script, _pick(letters, byte(i)))
        # letters of all other scripts, marks and other numbers
        return out.when(c.rlike(r"[\p{L}\p{M}\p{N}]"), _pick(ALPHABETS["latin"], byte(i))).otherwise(c)

    def mapped(f, chars: Column | str = "chars") -> Column:
        return F.array_join(F.transform(chars, f), "")

    numbers = mapped(lambda c, i: digit(i))
    card = F.concat(F.substr("normal", F.lit(1), F.lit(1)), F.substr(numbers, F.lit(2)))
    body = F.substring(card, 1, F.length("normal") - 1)
    check = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    local, domain = F.substring_index("normal", "@", 1), F.substring_index("normal", "@", -1)
    place = F.sha2(F.concat_ws("\0", F.lit(key), F.lit("domain"), domain).cast("binary"), 256)
    ending = _pick(["com", "net", "org"], F.conv(F.substr(place, F.lit(1), F.lit(2)), 16, 10).cast("int"))
    # where an address has too few others of its form, digits keep it apart
    apart = F.when(F.col("draw") < 8, "").otherwise(F.concat(*(digit(F.lit(i)) for i in range(100, 106))))
    email = F.concat(
        mapped(lambda c, i: same_class(c, i), _chars(local)), apart, F.lit("@m"), F.substr(place, F.lit(3), F.lit(10)), F.lit(".example."), ending
    )
    octets = F.concat_ws(".", *((byte(F.lit(i)) % 254 + 1).cast("string") for i in range(4)))
    kept = F.length(F.regexp_extract("normal", r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|[a-z]{2}(?=\d{2}))", 0))
    secret = mapped(lambda c, i: F.when(i < kept, c).otherwise(same_class(c, i)))

    def several(part) -> Column:
        """One more part each time the draw failed."""
        parts = F.transform(F.sequence(F.lit(0), F.col("draw")), lambda i: part(2 * i))
        return F.array_join(parts, "-")

    out = (
        F.when(F.col("kind") == "email", email)
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind").isin("ssn", "phone"), numbers)
        .when(F.col("kind") == "card", F.when(_luhn(F.col("normal")) % 10 == 0, check).otherwise(card))
        .when(F.col("kind").isin("hex", "ip6"), mapped(lambda c, i: same_class(c, i, True)))
        .when(F.col("kind").isin("secret", "iban"), secret)
    )
    for script, (begin, end) in SURNAMES.items():
        surname = lambda i, b=begin.split(), e=end.split(): F.concat(_pick(b, byte(i)), _pick(e, byte(i + 1)))
        out = out.when(F.col("kind") == f"surname {script}", several(surname))
    both = {("n", script): f"{GIVEN['f', script]} {GIVEN['m', script]}" for script in SURNAMES}
    for (gender, script), listed in (GIVEN | both).items():
        given = lambda i, n=listed.split(): _pick(n, byte(i))
        out = out.when(F.col("kind") == f"given {gender} {script}", several(given))
    return drawn.select("kind", "normal", "draw", out.alias("surrogate"))


def assign(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, normal, surrogate) for different (kind, normal): no two of a kind have the same surrogate,
    and none has the text of another entity of its kind."""
    now = frames.stage(_draw(entities.withColumn("draw", F.lit(0)), key), "surrogates")
    for _ in range(rounds):
        # the first of each surrogate keeps it, unless the surrogate is an original
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "normal")).alias("first"))
        originals = now.select("kind", F.col("normal").alias("original"))
        first = (
            first.join(
                originals,
                (first["kind"] == originals["kind"]) & (F.lower(first["surrogate"]) == F.lower(originals["original"])),
                "left_anti",
            )
            .select("kind", F.col("first.normal").alias("normal"))
        )
        first = frames.stage(first, "surrogates")
        again = now.join(first, ["kind", "normal"], "left_anti").select("kind", "normal", (F.col("draw") + 1).alias("draw"))
        again = frames.stage(_draw(again, key), "surrogates")
        if again.isEmpty():
            return now.drop("draw")
        now = frames.stage(now.join(first, ["kind", "normal"], "left_semi").unionByName(again), "surrogates")
    raise RuntimeError(f"surrogates still met after {rounds} rounds")


def _given(gender: str) -> list[str]:
    """The given names of a gender, in lower case."""
    listed = [given for g, given in GIVEN.items() if g[0] == gender]
    return [n.lower() for n in " ".join([*listed, names.TABLE[gender], names.BEFORE_A_NAME[gender]]).split()]


def _surnames(values: Column) -> Column:
    """A pattern for the surnames among these mentions wherever they stand alone, null without any."""
    several = F.filter(values, lambda v: v.rlike(r"^[\p{L}.'’ -]+ [\p{L}'’-]+$"))
    words = F.flatten(F.transform(several, lambda v: F.split(v, " ")))
    known = [n for gender in ("f", "m", "n") for n in _given(gender)]
    surname = lambda w: w.rlike(r"^\p{Lu}['’\p{L}-]{2,}$") & ~F.lower(w).isin(known) & ~w.isin(TITLES.split())
    found = F.array_distinct(F.filter(words, surname))
    either = F.array_join(F.array_distinct(F.concat(found, F.transform(found, F.upper))), "|")
    return F.when(F.size(found) > 0, F.concat(F.lit(f"{_BEFORE}(?:"), either, F.lit(f"){_AFTER}")))


def _words(mentions: DataFrame) -> DataFrame:
    """(digest, place, word, kind, normal, value): names word by word, with gender and script; titles have
    no normal text, as they stay; all else as it is."""
    kinds = mentions.withColumn("kind", _kind(F.col("value")))
    words = F.when(F.col("kind") == "name", F.split("value", " ")).otherwise(F.array("value"))
    each = kinds.select("digest", "place", "kind", F.posexplode(words).alias("word", "value"))
    low, script = F.lower("value"), _script(F.col("value"))
    kind = F.when(F.col("kind") != "name", F.col("kind"))
    kind = kind.when((F.col("word") == 0) & F.regexp_replace("value", r"\.$", "").isin(TITLES.split()), "title")
    kind = kind.when(F.col("value").isin(names.PARTICLES.split()), "title")
    for gender in ("f", "m", "n"):
        kind = kind.when(low.isin(_given(gender)), F.concat_ws(" ", F.lit(f"given {gender}"), script))
    each = each.withColumn("kind", kind.otherwise(F.concat_ws(" ", F.lit("surname"), script)))
    return each.withColumn("normal", F.when(F.col("kind") != "title", _normal(F.col("kind"), F.col("value"))))


def _as_mentioned(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate in the form of a mention: digits take the places of digits, from the last on; upper case
    stays upper case."""
    spare = F.length(_digits(value)) - F.length(surrogate)

    def placed(c: Column, i: Column) -> Column:
        at = F.length(_digits(F.substring(value, 1, i + 1))) - spare
        return F.when(c.rlike("[0-9]") & (at > 0), F.substr(surrogate, at, F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(_chars(value), placed), "")
    letter_at = lambda i: F.length(F.replace(F.substring(value, 1, i + 1), F.lit(" "), F.lit("")))
    spaced = F.transform(_chars(value), lambda c, i: F.when(c == " ", c).otherwise(F.substr(surrogate, letter_at(i), F.lit(1))))
    iban = F.upper(F.array_join(spaced, ""))
    upper = (value == F.upper(value)) & value.rlike(r"\p{L}") & (kind != "secret")
    out = F.when(kind.isin("phone", "card", "ssn"), numbers).when(kind == "iban", iban)
    return out.when(upper, F.upper(surrogate)).otherwise(surrogate)


def replace_pii(
    docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str = "n_entities", rounds: int = ROUNDS
) -> DataFrame:
    """`docs` with surrogates in the text, and how many mentions were replaced."""
    docs = docs.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).drop(count_col)
    text = F.col(text_col)
    found = _by_pattern(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    held = docs.withColumn("__digest", F.unhex(F.md5(text))).withColumn("__values", found)
    held = held.where(F.size("__values") > 0).withColumn("__surnames", _surnames(F.col("__values")))
    # surnames found in a text are looked for in what is left of it
    between = _by_pattern(text, lambda p: F.split(text, p))
    alone = lambda b: F.regexp_extract_all(b, F.col("__surnames"), F.lit(0))
    more = F.zip_with(between, "__values", lambda b, v: F.concat(alone(b), F.when(v.isNull(), F.array()).otherwise(F.array(v))))
    held = held.withColumn("__values", F.when(F.col("__surnames").isNull(), F.col("__values")).otherwise(F.flatten(more)))
    held = frames.stage(held, "texts_with_entities")
    texts = held.groupBy(F.col("__digest").alias("digest")).agg(F.any_value("__values").alias("values"))
    words = frames.stage(_words(texts.select("digest", F.posexplode("values").alias("place", "value"))), "mentions")
    surrogates = assign(words.where("normal is not null").select("kind", "normal").distinct(), key, rounds)
    formed = _as_mentioned(F.col("kind"), F.col("value"), F.col("surrogate"))
    new = words.join(surrogates, ["kind", "normal"], "left").withColumn("new", F.coalesce(formed, "value"))
    glue = lambda parts: F.array_join(F.sort_array(F.collect_list(parts))["new"], " ")
    mentions = new.groupBy("digest", "place").agg(glue(F.struct("word", "new")).alias("new"))
    lists = mentions.groupBy(F.col("digest").alias("__digest")).agg(
        F.sort_array(F.collect_list(F.struct("place", "new"))).alias("__new")
    )
    lists = frames.stage(lists.withColumn("__new", F.col("__new.new")), "replacements")
    apart = F.flatten(F.transform(between, lambda b: F.split(b, F.col("__surnames"))))
    between = F.when(F.col("__surnames").isNull(), between).otherwise(apart)
    glued = F.array_join(F.zip_with(between, "__new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    replaced = held.join(lists, "__digest").withColumn(count_col, F.size("__new")).withColumn(text_col, glued)
    others = docs.where(~_by_pattern(text, lambda p: text.rlike(p))).withColumn(count_col, F.lit(0))
    return others.unionByName(replaced.select(*others.columns))
