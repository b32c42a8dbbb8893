"""PII surrogates (operator 3), DataFrame functions only.

Entities are found by one pattern, in one pass that cuts each text into pieces; the pieces are written once, and all later steps read them. Each entity gets a
replacement of its own type and format, drawn from a keyed hash of its canonical form: digits for digits, letters for letters of the same script and case, valid
octets for addresses, a valid check digit for card numbers. The same entity always gets the same replacement, in any of its spellings, and a person the same
names with any title or none (coreference); bare mentions of a titled person's names in the same text are replaced too. A given name's gender is that of the
titles it has anywhere, else that of a list of common names. A pass over the distinct entities finds replacements that two of them share or that are themselves
real; those entities draw again until all differ, names and addresses with longer forms.
Only entities that drew again, and given names whose titles differ, are joined to documents; for the others the replacement is computed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, settled

# Honorifics by gender, in Latin, Cyrillic and Greek script.
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Signor", "господин", "г-н", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "госпожа", "г-жа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "д-р"]
# Common given names by gender; before a capitalised word they make a name without a title.
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Steven", "Paul", "Andrew", "Peter", "George", "Hans", "Klaus", "Jürgen", "Pierre", "Jacques", "Carlos", "José", "Juan", "Miguel", "Ahmed", "Mohammed", "Omar"]
FEMALE_NAMES = ["Mary", "Jane", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Margaret", "Emily", "Anna", "Maria", "Laura", "Helen", "Julia", "Ursula", "Monika", "Sabine", "Claire", "Sophie", "Camille", "Carmen", "Lucía", "Fatima", "Aisha"]

BROADCAST_ROWS = 100_000
#: From this attempt on a replacement gets longer with each draw, so that the forms of a short entity cannot run out.
GROW = 8
#: Code points that are no characters: the ends of an entity, an escape, and what the escape stands before.
MARK, ESCAPE, SAME_MARK, SAME_ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
PARTS = "array<struct<kind:string,canonical:string,gender:string>>"
PIECES = f"array<struct<kind:string,text:string,parts:{PARTS}>>"

_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_latin_titles = [t for t in MALE + FEMALE + NEUTRAL if t.isascii() or "ñ" in t]
_title = "(?:" + "|".join(sorted({*MALE, *FEMALE, *NEUTRAL, *(t.upper() for t in _latin_titles)}, key=lambda t: (-len(t), t))) + ")"
_given = "(?:" + "|".join(MALE_NAMES + FEMALE_NAMES) + ")"
# Groups that may repeat without end are possessive: the others take a stack frame a repetition.
_word, _caps = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+(?!\p{L}))*+", r"\p{Lu}{2,}(?:-\p{Lu}{2,}(?!\p{L}))*+"
_name_form = rf"(?<![\p{{L}}\p{{N}}])(?:{_title}\.?[ ](?:{_word}(?:[ ]{_word}){{0,2}}|{_caps}(?:[ ]{_caps}){{0,2}}|\p{{IsHan}}{{2,4}})|{_given}(?:-\p{{Lu}}\p{{Ll}}+)?[ ]{_word})(?!\p{{L}})"
_email_form = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++"
_ip_form = rf"(?<![\d.])(?<!(?i:version|release|ver|v)[ .:]{{0,2}}){_octet}(?:\.{_octet}){{3}}(?!\.?\d)"
_card_form = r"(?<![\p{L}\d])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\p{L}\d])"
_ssn_form = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_phone_form = r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\d])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d-])(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
_iban_form = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
_key_word = "(?i:password|passwd|secret|token|api_key)"
_secret_form = rf"(?<![A-Z0-9])AKIA[A-Z0-9]{{16}}(?![A-Z0-9])|(?<={_key_word}[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?)(?=[^\s\"'=:\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])[^\s\"'=:]{{7,}}[^\s\"'=:.,;)\]}}]"
ENTITY = "|".join([_name_form, _email_form, _secret_form, _ip_form, _ssn_form, _iban_form, _card_form, _phone_form])
#: Every entity holds a digit, an at sign, an assignment, a title or a common given name; other texts are not searched further.
HINT = rf"[0-9@]|{_key_word}|(?<!\p{{L}})(?:{_title}[. ]|{_given}[ -])"

_latin, _cyrillic, _greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_han = "安本成春达德东恩方芳飞丰国海华慧建健江杰金静军凯康兰磊力丽林玲龙美敏明宁平琪倩强青清荣瑞珊世书思天文武晓欣秀雪亚燕阳怡英勇宇玉元云泽志忠"
_syllables = {
    "latin": (["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "tr"], ["a", "e", "i", "o", "u", "ai", "ei", "au"]),
    "cyrillic": (["б", "в", "г", "д", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "бр", "тр"], ["а", "е", "и", "о", "у", "я", "ю", "э"]),
    "greek": (["β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "τρ", "κρ"], ["α", "ε", "η", "ι", "ο", "υ", "ω", "αι"]),
}
_endings = {
    "latin": {"given_m": ["o", "er", "an", "us"], "given_f": ["a", "ia", "ine", "elle"], "given_n": ["i", "is", "y", "el"], "surname": ["son", "mann", "ez", "ier"]},
    "cyrillic": {"given_m": ["ий", "ор", "ан", "ей"], "given_f": ["а", "ия", "ина", "ея"], "given_n": ["и", "ис", "ы", "ель"], "surname": ["енко", "ук", "ич", "ер"]},
    "greek": {"given_m": ["ος", "ης", "ας", "ων"], "given_f": ["α", "η", "ια", "ω"], "given_n": ["ι", "ις", "υ", "ελ"], "surname": ["ιδης", "ακης", "ου", "ερ"]},
}


def _pick(options: list[str] | str, pair: Column) -> Column:
    """One of the options (or letters) by a number."""
    at = (pair % len(options)).cast("int") + 1
    return F.substring(F.lit(options), at, F.lit(1)) if isinstance(options, str) else F.element_at(F.split(F.lit(" ".join(options)), " "), at)


def _draw(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string")), 512)


def _number(stream: Column, i) -> Column:
    """The i-th of 32 numbers below 65536 of a hash."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32
    return F.conv(F.substring(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def kind_of(entity: Column) -> Column:
    """The type of a found entity; null for digits that only look like a card number, as their check digit is wrong."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    valid = let(F.regexp_replace(entity, r"\D", ""), lambda d: _luhn(d, F.length(d), True) % 10 == 0)
    return (
        F.when(entity.rlike(rf"^{_title}\.?[ ]\p{{IsHan}}"), F.lit("han"))
        .when(entity.rlike(rf"^(?:{_title}\.?|{_given}(?:-\p{{L}}+)?)[ ]\p{{Lu}}"), F.lit("name"))
        .when(entity.contains("@"), F.lit("email"))
        .when(whole(rf"{_octet}(?:\.{_octet}){{3}}"), F.lit("ip"))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), F.lit("ssn"))
        .when(whole(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}"), F.when(valid, F.lit("card")))
        .when(whole(r"AKIA[A-Z0-9]{16}"), F.lit("secret"))
        .when(whole(_iban_form), F.lit("iban"))
        .when(entity.rlike(r"^[+(\d][\d ().-]+\d$"), F.lit("phone"))
        .otherwise(F.lit("secret"))
    )


def canonical_of(kind: Column, entity: Column) -> Column:
    """One form for all spellings of an entity: a number of the North American plan is the same with its country code and without."""
    phone = F.regexp_replace(F.regexp_replace(entity, r"\D", ""), r"^1(?=\d{10}$)", "")
    return (
        F.when(kind == "email", F.lower(entity)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), F.regexp_replace(entity, r"\D", "")).when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "han", F.regexp_replace(entity, rf"^{_title}\.?[ ]", "")).otherwise(entity)
    )


def _same_shape(text: Column, stream: Column, kept, hexadecimal=None) -> Column:
    """Letters and digits of text from character `kept` on are drawn anew within their class."""
    kept = F.lit(kept) if isinstance(kept, int) else kept

    def char(c: Column, i: Column) -> Column:
        n = _number(stream, i) + F.floor(i / 32).cast("int") * 7
        low = F.lower(c)
        latin = _pick(_latin, n) if hexadecimal is None else F.when(hexadecimal, _pick("abcdef", n)).otherwise(_pick(_latin, n))
        drawn = F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(low.rlike(r"\p{IsCyrillic}"), _pick(_cyrillic, n)).when(low.rlike(r"\p{IsGreek}"), _pick(_greek, n)).otherwise(latin)
        return F.when(c.rlike(r"[^\p{L}\p{N}]") | (c == "") | (i < kept), c).when(c != low, F.upper(drawn)).otherwise(drawn)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _luhn(digits: Column, n: Column, with_check: bool) -> Column:
    """Luhn sum of a digit string; the check digit itself stands last if with_check."""
    shift = 0 if with_check else 1

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i + shift) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weighed(i))


def _email(canonical: Column, stream: Column, key: str, attempt: Column) -> Column:
    """Local part and domain in their own shapes; equal domains stay equal while nothing is drawn again."""

    def of(local: Column, domain: Column) -> Column:
        tail = F.substring_index(domain, ".", -1)
        host = F.substring(domain, F.lit(1), F.greatest(F.length(domain) - F.length(tail) - 1, F.lit(0)))
        longer = F.when(attempt > 3, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - 3, F.lit(1))), lambda i: _pick(_latin, _number(stream, i + 16))), "")).otherwise(F.lit(""))
        shaped = F.transform(F.array(F.struct(local.alias("x"), stream.alias("by")), F.struct(host.alias("x"), _draw(key, F.lit("domain"), domain, attempt).alias("by"))), lambda p: _same_shape(p["x"], p["by"], 0))
        return let(shaped, lambda p: F.concat(p[0], longer, F.lit("@"), p[1], F.lit("."), tail))

    return let(F.substring_index(canonical, "@", 1), lambda local: let(F.substring_index(canonical, "@", -1), lambda domain: of(local, domain)))


def _with_check_digit(drawn: Column) -> Column:
    """A card number with the check digit that its other digits ask for."""
    n = F.length(drawn)
    payload = F.substring(drawn, F.lit(1), n - 1)
    return F.concat(payload, F.pmod(10 - let(payload, lambda p: _luhn(p, n - 1, False)) % 10, F.lit(10)).cast("string"))


def _name(kind: Column, gender: Column, stream: Column, attempt: Column, script: str) -> Column:
    heads, vowels = _syllables[script]
    syllable = lambda i: F.concat(_pick(heads, _number(stream, 2 * i)), _pick(vowels, _number(stream, 2 * i + 1)))
    last = F.when(kind == "surname", 2).otherwise(1) + F.floor(attempt / 3).cast("int")
    stem = F.array_join(F.transform(F.sequence(F.lit(0), last), syllable), "")
    of = F.when(kind == "surname", F.lit("surname")).when(gender == "m", F.lit("given_m")).when(gender == "f", F.lit("given_f")).otherwise(F.lit("given_n"))
    ending = F.coalesce(*[F.when(of == k, _pick(ends, _number(stream, 20))) for k, ends in _endings[script].items()])
    return F.initcap(F.concat(stem, ending))


def replacement(key: str, kind: Column, canonical: Column, gender: Column, attempt: Column) -> Column:
    """The replacement of a canonical entity (names: of one name part). The arguments are columns or lambda variables, not expressions."""

    def of(stream: Column) -> Column:
        kept = F.when(kind.isin("card", "phone"), F.when(F.length(canonical) > 10, F.when(kind == "card", 1).otherwise(2)).otherwise(1)).when(kind == "iban", 2).when(canonical.startswith("AKIA"), 4).otherwise(0)
        more = F.when(attempt > GROW, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - GROW, F.lit(1))), lambda i: _pick("0123456789", _number(stream, i + 16))), "")).otherwise(F.lit(""))
        shaped = F.concat(_same_shape(canonical, stream, kept, canonical.rlike("^[0-9a-f]+$")), more)
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(stream, i) % 254 + 1).cast("string")), ".")
        groups = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.lower(F.hex(_number(stream, i)))), ":"))
        han = F.transform(F.sequence(F.lit(1), F.length(canonical) + F.floor(attempt / 4).cast("int")), lambda i: _pick(_han, _number(stream, i)))
        named = lambda script: _name(kind, gender, stream, attempt, script)
        return (
            F.when(kind == "email", _email(canonical, stream, key, attempt))
            .when(kind == "ip", F.when(attempt > GROW, groups).otherwise(octets))
            .when(kind == "han", F.array_join(han, ""))
            .when(kind.isin("given", "surname"), F.when(canonical.rlike(r"\p{IsCyrillic}"), named("cyrillic")).when(canonical.rlike(r"\p{IsGreek}"), named("greek")).otherwise(named("latin")))
            .when(kind == "card", let(shaped, _with_check_digit))
            .otherwise(shaped)
        )

    return let(_draw(key, kind, canonical, attempt), of)


def _dressed(kind: Column, entity: Column, new: Column) -> Column:
    """The replacement of the canonical form in the spelling of the entity: its separators, a country code that the canonical form lacks, and its case."""
    plain = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))

    def layout(n: Column) -> Column:
        seen = lambda i: plain(F.substring(entity, F.lit(1), i + 1)) - (plain(entity) - n)
        chars = F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]") & (seen(i) > 0), F.substring(new, seen(i), F.lit(1))).otherwise(c))
        return F.concat(F.array_join(chars, ""), F.substring(new, n + 1, F.length(new)))

    laid_out = let(F.length(canonical_of(kind, entity)), layout)
    own = lambda i: F.substring(new, i + 1, F.lit(1))
    cased = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c != F.lower(c), F.upper(own(i))).otherwise(own(i))), "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), laid_out).when((kind == "email") & (entity != F.lower(entity)) & (F.length(entity) == F.length(new)), cased).otherwise(new)


def _entry(kind, canonical: Column, gender) -> Column:
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(column(kind).alias("kind"), canonical.alias("canonical"), column(gender).alias("gender"))


def _parts(kind: Column, entity: Column) -> Column:
    """The dictionary entries (kind, canonical, gender) of a found entity: itself, or the given names and the surname of a name."""

    def of_name(words: Column, title: Column) -> Column:
        of_title = F.when(F.lower(title).isin([t.lower() for t in MALE]), F.lit("m")).when(F.lower(title).isin([t.lower() for t in FEMALE]), F.lit("f"))
        known = lambda p: F.when(F.initcap(p).isin(MALE_NAMES), F.lit("m")).when(F.initcap(p).isin(FEMALE_NAMES), F.lit("f")).otherwise(F.lit(""))
        entry = lambda p, last: _entry(F.when(last, "surname").otherwise("given"), p, F.when(last, "").otherwise(F.coalesce(of_title, known(p))))
        return F.flatten(F.transform(words, lambda w, i: F.transform(F.split(F.lower(w), "-"), lambda p: entry(p, i == F.size(words) - 1))))

    words, title = F.split(F.regexp_replace(entity, rf"^{_title}\.?[ ]", ""), " "), F.regexp_extract(entity, rf"^({_title})\.?[ ]", 1)
    return F.when(kind == "name", let(words, lambda w: let(title, lambda t: of_name(w, t)))).otherwise(F.array(_entry(kind, canonical_of(kind, entity), "")))


def _piece(kind, text: Column, parts: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), parts.alias("parts"))


def _cut(text: Column) -> Column:
    """A text in pieces (kind, text, parts): what is between entities, of no kind and escaped, and entities."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + SAME_ESCAPE)), F.lit(MARK), F.lit(ESCAPE + SAME_MARK))
    escaped = F.when(text.rlike(f"[{MARK}{ESCAPE}]"), escaped).otherwise(text)
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast(PARTS)
    entity = lambda e: let(kind_of(e), lambda kind: _piece(kind, e, F.when(kind.isNotNull(), _parts(kind, e))))
    found = F.transform(F.split(F.regexp_replace(escaped, ENTITY, f"{MARK}$0{MARK}"), MARK, -1), lambda p, i: F.when(i % 2 == 1, entity(p)).otherwise(_piece(nothing, p, none)))
    return F.when(text.rlike(HINT), found).when(text.isNotNull(), F.array(_piece(nothing, escaped, none))).cast(PIECES)


def _people(pieces: Column) -> Column:
    """The entries of all names in the pieces, and one pattern for their bare mentions (null without names)."""
    people = F.array_distinct(F.flatten(F.transform(F.filter(pieces, lambda p: p["kind"].isin("name", "han")), lambda p: p["parts"])))
    forms = lambda who: F.array_distinct(F.flatten(F.transform(who, lambda x: F.array(F.initcap(x["canonical"]), F.upper(x["canonical"])))))
    spaced = lambda who: forms(F.filter(who, lambda x: (x["kind"] != "han") & (F.length(x["canonical"]) > 1)))
    han = lambda who: F.transform(F.filter(who, lambda x: x["kind"] == "han"), lambda x: x["canonical"])
    bounded = lambda f: F.when(F.size(f) > 0, F.array(F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(f, "|"), F.lit(r")(?![\p{L}\p{N}])")))).otherwise(F.array().cast("array<string>"))
    pattern = lambda who: F.nullif(F.array_join(F.concat(bounded(spaced(who)), han(who)), "|"), F.lit(""))
    return let(people, lambda who: F.struct(who.alias("entries"), pattern(who).alias("pattern")))


def _with_bare(pieces: Column, people: Column) -> Column:
    """The pieces, with bare mentions of people's names as entities of their own; a word that is a surname and a given name counts as the surname."""
    entry = lambda word: F.array_max(F.filter(people["entries"], lambda x: x["canonical"] == F.lower(word)))
    split = lambda text: F.split(F.regexp_replace(text, people["pattern"], F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    mentions = lambda text: F.transform(split(text), lambda q, i: _piece(F.when(i % 2 == 1, F.lit("bare")), q, F.when(i % 2 == 1, F.array(entry(q)))))
    return F.when(people["pattern"].isNotNull(), F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull(), mentions(p["text"])).otherwise(F.array(p))))).otherwise(pieces)


def _set_apart(entries: DataFrame, key: str) -> DataFrame:
    """kind, canonical, attempt, gender of the entries that are not as their own mention says: because the first replacement is taken by another entry or is itself
    real, or because a given name has several titles.

    Each round, an entry keeps its draw if no real one and no settled draw of its kind equals it and it is the first (by canonical form) to draw it.
    """
    has = lambda g: F.max(F.col("gender") == g)
    gender = F.when(F.col("m") & ~F.col("f"), F.lit("m")).when(F.col("f") & ~F.col("m"), F.lit("f")).otherwise(F.lit(""))
    real = entries.groupBy("kind", "canonical").agg(has("m").alias("m"), has("f").alias("f"), F.countDistinct("gender").alias("kinds"))
    real = settled(real.select("kind", "canonical", gender.alias("gender"), (F.col("kinds") > 1).alias("mixed")), "entities")
    new = lambda attempt: let(replacement(key, F.col("kind"), F.col("canonical"), F.col("gender"), attempt), lambda x: F.when(F.col("kind").isin("given", "surname"), F.lower(x)).otherwise(x))
    drawn = settled(real.select("kind", "canonical", "gender", "mixed", F.lit(0).alias("attempt"), new(F.lit(0)).alias("new")), "entities")
    attempt = 0
    while True:
        first = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canonical")).alias("keeper"), F.count("*").alias("n"))
        shared = drawn.join(first.where("n > 1"), ["kind", "new"]).where("struct(attempt, canonical) <> keeper").select("kind", "canonical")
        true = drawn.join(real.select("kind", F.col("canonical").alias("new")), ["kind", "new"], "left_semi").select("kind", "canonical")
        again = settled(shared.union(true).distinct(), "entities")
        if again.isEmpty():
            return drawn.where("attempt > 0 OR mixed").select("kind", "canonical", "attempt", "gender")
        attempt += 1
        fresh = drawn.join(again, ["kind", "canonical"], "left_semi").select("kind", "canonical", "gender", "mixed", F.lit(attempt).alias("attempt"), new(F.lit(attempt)).alias("new"))
        drawn = settled(drawn.join(again, ["kind", "canonical"], "left_anti").unionByName(fresh), "entities")


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten, all other columns as they are, and a last column `n_entities` (renamed if there is one already).

    A secret without a letter or digit (a mask) is no entity. Null texts stay null and have 0 entities; rows with null or repeated ids are rewritten each for itself. Entities of one kind with different canonical forms never
    share a replacement. Digits like a card number with a wrong check digit are no entity, nor is a dotted number after a word for version. Very long texts are taken
    whole. Empty tables give an empty result; columns may have any names.
    """
    columns, count = docs.columns, "n_entities"
    while count in columns:
        count += "_"
    rows = docs.select(F.struct(*[F.col(c) for c in columns if c != text_col], F.lit(0).alias(MARK)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc", _cut(F.col("text")).alias("cut")).select("doc", "cut", _people(F.col("cut")).alias("people")).select("doc", _with_bare(F.col("cut"), F.col("people")).alias("pieces"))
    rows = settled(rows.withColumn("n", F.coalesce(F.size(F.filter("pieces", lambda p: p["kind"].isNotNull())), F.lit(0))).withColumn("row", F.monotonically_increasing_id()), "pieces")
    some, parts = rows.where("n > 0"), F.flatten(F.transform(F.filter("pieces", lambda p: p["kind"].isNotNull()), lambda p: p["parts"]))
    again = settled(_set_apart(some.select(F.explode(parts).alias("p")).select("p.*").distinct(), key), "entities")
    n_again = again.count()

    some, apart = some.select("row", "doc", "pieces", "n"), "map<string,struct<attempt:int,gender:string>>"
    if n_again:
        wanted = some.select("row", F.explode(F.array_distinct(parts)).alias("p")).select("row", "p.kind", "p.canonical").distinct()
        wanted = wanted.join(F.broadcast(again) if n_again <= BROADCAST_ROWS else again, ["kind", "canonical"])
        maps = wanted.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canonical"), F.struct("attempt", "gender")))).alias("apart"))
        maps = settled(maps, "entities")
        some = some.join(F.broadcast(maps) if maps.count() <= BROADCAST_ROWS else maps, "row", "left")
    else:
        some = some.withColumn("apart", F.lit(None).cast(apart))

    def new(part: Column) -> Column:
        own = F.struct(F.lit(0).alias("attempt"), part["gender"].alias("gender"))
        found = F.when(F.col("apart").isNotNull(), F.coalesce(F.element_at("apart", F.concat_ws("|", part["kind"], part["canonical"])), own)).otherwise(own)
        return let(found, lambda x: replacement(key, part["kind"], part["canonical"], x["gender"], x["attempt"]))

    cased = lambda new, word: F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(new)

    def named(title: Column, rest: Column, news: Column) -> Column:
        """The new words between the old separators."""
        seps = F.regexp_extract_all(rest, F.lit("([ -])"), F.lit(1))
        joined = lambda words, seps: F.array_join(F.transform(words, lambda w, i: F.concat(cased(F.element_at(news, i + 1), w), F.coalesce(F.get(seps, i), F.lit("")))), "")
        return let(F.split(rest, "[ -]"), lambda words: let(seps, lambda s: F.concat(title, joined(words, s))))

    def written(kind: Column, entity: Column, news: Column) -> Column:
        title = F.regexp_extract(entity, rf"^({_title}\.?[ ])", 1)
        full = let(title, lambda t: let(F.substring(entity, F.length(t) + 1, F.length(entity)), lambda rest: named(t, rest, news)))
        return F.when(kind == "name", full).when(kind == "han", F.concat(title, news[0])).when(kind == "bare", cased(news[0], entity)).otherwise(_dressed(kind, entity, news[0]))

    plain = lambda t: F.replace(F.replace(t, F.lit(ESCAPE + SAME_MARK), F.lit(MARK)), F.lit(ESCAPE + SAME_ESCAPE), F.lit(ESCAPE))
    joined = lambda pieces: let(F.array_join(pieces, ""), lambda t: F.when(t.contains(ESCAPE), plain(t)).otherwise(t))
    text = joined(F.transform("pieces", lambda p: F.when(p["kind"].isNotNull(), let(F.transform(p["parts"], new), lambda news: written(p["kind"], p["text"], news))).otherwise(p["text"])))
    some = some.select("doc", text.alias("text"), "n")
    others = rows.where("n = 0").select("doc", joined(F.transform("pieces", lambda p: p["text"])).alias("text"), "n")
    return some.unionByName(others).select(*[F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in columns], F.col("n").cast("long").alias(count))
