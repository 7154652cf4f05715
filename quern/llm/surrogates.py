"""Personal data replaced by keyed surrogates (native: DataFrame expressions only).

One pattern finds e-mail addresses, telephone numbers, IP addresses, card, bank
and social security numbers, secrets, and names of up to four parts behind a title. Names
that a text has behind a title are found again wherever it repeats them without one. A text
is split at the matches; segments and matches alternate, so replacing is a join of arrays.

Each distinct entity (type and canonical form) gets one surrogate for the whole
corpus, drawn from a keyed digest: same type, same length and punctuation,
country codes and top-level domains kept, capitals where they were, valid octets, valid check digits
where the original had them, and for names the gender of the title and the script
of the name. Names are replaced part by part, so that "Mr Smith" and "Mr John
Smith" still agree. Differently written forms of a number stay one entity.

Collision checks: a surrogate that equals a real entity, or another's surrogate,
is drawn again with the next nonce. Where a format has so few values that ROUNDS
draws don't end it (more than half of them real, as a rule), what is left of the format is
permuted by a keyed order among itself: those surrogates are real values of others, and each
still differs from its own entity and from all other surrogates. Distinct entities
stay distinct, and equal ones equal.

Only occurrences are shuffled, and the texts that hold one. Defined cases: a
null text stays null; a text without entities stays as it is, as do empty ones; long texts are
searched whole; repeated rows get the same text; of equal draws the least entity keeps its own;
an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, scratch, stored, text_of

BROADCAST_ROWS = 200_000
#: Draws before the rest of a format is permuted; rows of a permutation that meet in one task.
ROUNDS, RING_ROWS = 8, 5_000
MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Sir", "Lord", "Mister", "Г-н", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Dame", "Lady", "Mlle", "Mademoiselle", "Signorina", "Señorita", "Srta", "Dra", "Г-жа", "Госпожа", "Κυρία"]
#: Titles without a gender.
NEUTRAL = ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Mx", "Rev", "Reverend", "Capt", "Captain", "Sgt", "Dott", "Д-р", "Проф"]
#: Syllables of made-up names, by script; endings of given names by gender.
SYLLABLES = {
    "latin": ["bel", "cor", "dan", "fer", "gal", "hol", "jar", "kel", "lom", "mar", "nor", "pel", "ros", "sel", "tam", "ver"],
    "cyrillic": ["бел", "вор", "дан", "гал", "жар", "кел", "лом", "мар", "нор", "пел", "рос", "сел", "там", "вер", "зор", "чер"],
    "greek": ["βελ", "δαν", "φερ", "γαλ", "κορ", "λομ", "μαρ", "νορ", "πελ", "ροσ", "σελ", "ταμ", "βερ", "ζορ", "θελ", "χαρ"],
}
ENDINGS = {"latin": {"m": "o", "f": "a", "n": "en"}, "cyrillic": {"m": "ий", "f": "ия", "n": "ов"}, "greek": {"m": "ος", "f": "α", "n": "ιδης"}}

_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")"
_BLANK = "[\\s\\u00A0]{1,2}"
#: One part of a name: inner capitals, one hyphen or apostrophe, or an initial.
_NAME = "\\p{Lu}\\p{L}{0,30}(?:['’\\-]\\p{L}{1,30})?"
_PART = f"(?:\\p{{Lu}}\\.|{_NAME}){_BLANK}"
_HEX = "[0-9A-Fa-f]{1,4}"
_GROUPS = f"(?:{_HEX}(?::{_HEX}){{0,6}})?"
#: Country codes; none begins with another.
_COUNTRY = "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PATTERNS = [
    ("EMAIL", "(?<![\\p{L}\\p{N}._%+\\-])[\\p{L}\\p{N}._%+\\-]++@[\\p{L}\\p{N}\\-]++(?:\\.[\\p{L}\\p{N}\\-]++)*\\.\\p{L}{2,}+"),
    ("SECRET", "(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])"),
    ("IBAN", "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("IP", "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?!\\.?[0-9])"),
    ("SSN", "(?<![0-9\\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\\-])"),
    ("IPV6", f"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{{0,4}}:)(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|{_GROUPS}::{_GROUPS})(?![0-9A-Za-z:]|\\.[0-9])"),
    ("CARD", "(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}(?:[ \\-][0-9]{4}){3}|3[47][0-9]{2}[ \\-][0-9]{6}[ \\-][0-9]{5}|3[0689][0-9]{2}[ \\-][0-9]{6}[ \\-][0-9]{4})(?![0-9])"),
    ("PHONE", "(?<![0-9+])(?:\\+[0-9]{1,3}[ .\\-]?(?:\\([0-9]{1,4}\\)[ .\\-]?)?[0-9]{2,4}(?:[ .\\-]?[0-9]{2,4}){1,4}"
     "|(?:1[ .\\-])?(?:\\([0-9]{3}\\)[ .\\-]?|[0-9]{3}[ .\\-])[0-9]{3}[ .\\-][0-9]{4}|\\(0[0-9]{1,4}\\)[ .\\-]?[0-9]{3,4}[ .\\-]?[0-9]{3,4}"
     "|0[0-9]{2,4}[ .\\-][0-9]{3,4}[ .\\-][0-9]{3,4}|0[0-9]{3,4}[ \\-][0-9]{6}|0[0-9](?:[ .\\-][0-9]{2}){4})(?![0-9])"),
    # the looks behind are dear, and made only where a name can begin; the longest only after a word with a capital
    ("NAME", f"(?<=[\\s\\u00A0])(?=\\p{{Lu}})(?:(?<=(?<!\\p{{L}}){_TITLE}\\.?{_BLANK})|(?<=(?<!\\p{{L}})\\p{{Lu}}[\\p{{L}}'’.\\-]{{0,61}}{_BLANK})(?<=(?<!\\p{{L}}){_TITLE}\\.?{_BLANK}{_PART}(?:{_PART})?(?:{_PART})?))(?!{_TITLE}(?!\\p{{L}})){_NAME}(?!\\p{{L}})"),
]
ALL = "|".join(p for _, p in PATTERNS)
#: What every match has: a digit, an at sign, a secret without either, or a title before a capital. Cheap, and false for most texts.
HINT = f"[0-9@]|(?:AKIA|ASIA)[A-Z]{{16}}|gh[pousr]_[A-Za-z]|sk-[A-Za-z]|[a-f]{{32}}|[A-F]{{32}}|(?=[{''.join(sorted({x[0] for x in MALE + FEMALE + NEUTRAL}))}]){_TITLE}\\.?{_BLANK}\\p{{Lu}}"
NAMES = ("FAMILY", "GIVEN_M", "GIVEN_F")


def split_up(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, segs (what stands between matches) and ents (the matches); one segment more than matches."""
    return df.select(*keep, F.split(F.col(text), ALL, -1).alias("segs"), F.regexp_extract_all(text, F.lit(ALL), F.lit(0)).alias("ents"))


def _kind(i: Column, named: Column | None = None) -> Column:
    """Type of the match i of segs and ents; of names with gender, from the title before them, or that of the same word in named, (entity, kind) of the text's names."""
    e, before, after = F.get("ents", i), F.get("segs", i), F.get("segs", i + 1)
    male, female = ("(?:^|[^\\p{L}])(?:" + "|".join(x) + f")\\.?{_BLANK}$" for x in (MALE, FEMALE))
    title = before.rlike(male) | before.rlike(female)
    full = after.rlike(f"^\\.?{_BLANK}$") & F.coalesce(F.get("ents", i + 1), F.lit("")).rlike(f"^{_NAME}$")
    other = F.lit("FAMILY") if named is None else F.coalesce(F.get(F.filter(named, lambda x: x["entity"] == e), F.lit(0))["kind"], F.lit("FAMILY"))
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in PATTERNS[:-1]:
        out = out.when(e.rlike(f"^(?:{pattern})$"), name)
    out = out.when(e.rlike(f"^{_NAME}$"), F.when(title & full, F.when(before.rlike(male), "GIVEN_M").otherwise("GIVEN_F")).when(title, "FAMILY").otherwise(other))
    return out.otherwise("OTHER")


def canonical(kind: Column, e: Column) -> Column:
    """What two writings of one entity share."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(kind == "PHONE", F.when(e.startswith("+"), F.regexp_replace(digits, f"^({_COUNTRY})", "+$1 ")).otherwise(digits))
        .when(kind.isin("CARD", "SSN"), digits)
        .when(kind == "IBAN", F.regexp_replace(e, " ", ""))
        .when(kind.isin("EMAIL", "IPV6"), F.lower(e))
        .when(kind.isin("FAMILY", "GIVEN_M", "GIVEN_F"), F.lower(F.translate(e, "’", "'")))
        .otherwise(e)
    )


def _draw(h: Column, i: Column | int) -> Column:
    """Number below 65536 at position i of a digest of 128 hex digits; positions run round with another stride."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(F.concat(h, h), (F.pmod(i * 5, F.lit(128)) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _same_classes(value: Column, h: Column, digits: str = "0123456789", upper: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """value with every digit and letter drawn anew within its class."""

    def new(c: Column, i: Column) -> Column:
        pick = lambda s: F.substring(F.lit(s), (F.pmod(_draw(h, i), F.lit(len(s))) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("^[0-9]$"), pick(digits)).when(c.rlike("^\\p{Lu}$"), pick(upper)).when(c.rlike("^\\p{L}$"), pick(lower)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), new), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check digit rule; a number is valid where it is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _mod97(iban: Column) -> Column:
    """Remainder of the number that an IBAN stands for; 1 where its check digits are right."""
    turned = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _name(kind: Column, canon: Column, h: Column, nonce: Column) -> Column:
    script = F.when(canon.rlike("\\p{IsCyrillic}"), "cyrillic").when(canon.rlike("\\p{IsGreek}"), "greek").otherwise("latin")

    def made(parts: list[str]) -> Column:
        pick = lambda i: F.get(F.array(*(F.lit(x) for x in parts)), F.pmod(_draw(h, i), F.lit(len(parts))))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + nonce), pick), "")

    out = F.when(F.lit(False), F.lit(""))
    for s, parts in SYLLABLES.items():
        end = F.when(kind == "GIVEN_M", ENDINGS[s]["m"]).when(kind == "GIVEN_F", ENDINGS[s]["f"]).otherwise(ENDINGS[s]["n"])
        out = out.when(script == s, F.concat(made(parts), end))
    return out


def surrogate(kind: Column, canon: Column, nonce: Column, key: str) -> Column:
    """The canonical form of the surrogate."""
    digest = lambda *what: F.sha2(F.concat_ws("\x1f", F.lit(key), *what, nonce.cast("string")), 512)
    h = digest(kind, canon)
    domain = F.substring_index(canon, "@", -1)
    stem = F.regexp_replace(domain, "\\.\\p{L}+$", "")
    email = F.concat(_same_classes(F.substring_index(canon, "@", 1), h), F.lit("@"), _same_classes(stem, F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("DOMAIN"), domain), 512)), F.regexp_extract(domain, "\\.\\p{L}+$", 0))
    octets = F.array_join(F.array(*((F.pmod(_draw(h, i), F.lit(254)) + 1).cast("string") for i in range(4))), ".")
    code = F.regexp_extract(canon, "^\\+[0-9]+ ", 0)
    phone = F.concat(code, _same_classes(F.substring(canon, F.length(code) + 1, F.length(canon)), h))
    drawn = F.concat(F.substring(canon, 1, 1), _same_classes(F.substring(canon, F.lit(2), F.length(canon) - 2), h))
    check = F.pmod(-_luhn(F.concat(drawn, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(drawn, F.when(_luhn(canon) % 10 == 0, check).otherwise(F.pmod(_draw(h, 99), F.lit(10)).cast("string")))
    secret = F.when(canon.rlike("^[0-9a-f]+$"), F.substring(F.concat(h, F.sha2(h, 512)), F.lit(1), F.length(canon))).when(canon.rlike("^[0-9A-F]+$"), F.upper(F.substring(F.concat(h, F.sha2(h, 512)), F.lit(1), F.length(canon))))
    marked = F.regexp_extract(canon, "^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0)
    secret = secret.otherwise(F.concat(marked, _same_classes(F.substring(canon, F.length(marked) + 1, F.length(canon)), h)))
    account = _same_classes(F.substring(canon, F.lit(5), F.length(canon)), h)
    checks = F.lpad((98 - _mod97(F.concat(F.substring(canon, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canon, 1, 2), F.when(_mod97(canon) == 1, checks).otherwise(_same_classes(F.substring(canon, 3, 2), F.reverse(h))), account)
    return (
        F.when(kind == "EMAIL", email).when(kind == "IP", octets).when(kind == "IPV6", _same_classes(canon, h, lower="abcdef")).when(kind == "PHONE", phone).when(kind == "CARD", card).when(kind == "SECRET", secret).when(kind == "IBAN", iban)
        .when(kind.isin("FAMILY", "GIVEN_M", "GIVEN_F"), _name(kind, canon, h, nonce)).otherwise(_same_classes(canon, h))
    )


def shape(kind: Column, canon: Column) -> Column:
    """What a surrogate keeps of its entity: entities of one shape have their surrogates in one space."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(canon, "[0-9]", "0"), "\\p{Lu}", "A"), "[\\p{L}&&[^A]]", "a")
    return (
        F.when(kind == "EMAIL", F.concat(F.substring_index(classes, "@", 1), F.lit("@"), F.substring_index(canon, "@", -1)))
        .when(kind == "IP", "")
        .when(kind == "PHONE", F.concat(F.regexp_extract(canon, "^\\+[0-9]+ ", 0), classes))
        .when(kind == "CARD", F.concat(F.substring(canon, 1, 1), F.length(canon).cast("string"), (_luhn(canon) % 10 == 0).cast("string")))
        .when(kind == "IBAN", F.concat(F.substring(canon, 1, 2), (_mod97(canon) == 1).cast("string"), classes))
        .otherwise(classes)
    )


def rendered(kind: Column, e: Column, new: Column) -> Column:
    """The surrogate in the writing of the entity e: its digits and letters at the places of e's, its capitals where e has some."""
    at = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    plain = F.regexp_replace(new, "[^0-9A-Za-z]", "")
    spread = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(plain, at(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(e, i + 1, F.lit(1)).rlike("^\\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    name = F.when((F.length(e) > 1) & (e == F.upper(e)), F.upper(new)).otherwise(F.initcap(new))
    return F.when(kind.isin("PHONE", "CARD", "SSN", "IBAN"), spread).when(kind.isin("EMAIL", "IPV6") & e.rlike("\\p{Lu}"), cased).when(kind.isin(*NAMES), name).otherwise(new)


def _ring(left: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(kind, new, canon) of what the draws left: of one shape, each takes the next one's value in a keyed order.

    A lone one changes places with the least that is done of its shape; if there is none, its last character moves on.
    """
    order = F.xxhash64(F.lit(key), "kind", "canon")
    left = left.select("kind", "canon", shape(F.col("kind"), F.col("canon")).alias("shape"), order.alias("order"))
    sizes = left.groupBy("kind", "shape").agg(F.count("*").alias("n"))
    left = left.join(sizes, ["kind", "shape"]).withColumn("ring", F.pmod("order", F.greatest(F.lit(1), F.floor(F.col("n") / RING_ROWS))))
    window = Window.partitionBy("kind", "shape", "ring").orderBy("order", "canon")
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ringed = left.filter("n > 1").select("kind", F.coalesce(F.lead("canon").over(window), F.first("canon").over(whole)).alias("new"), "canon")
    lone = left.filter("n = 1").select("kind", "shape", F.col("canon").alias("own"))
    partners = done.withColumn("shape", shape(F.col("kind"), F.col("canon"))).join(lone, ["kind", "shape"], "left_semi").groupBy("kind", "shape").agg(F.min(F.struct("canon", "new")).alias("p"))
    lone = lone.join(partners, ["kind", "shape"], "left")
    last = F.substring("own", -1, 1)
    moved = F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.when(last.rlike("[0-9]"), F.pmod(last.cast("int") + 1, F.lit(10)).cast("string")).when(last == "z", "a").when(last == "Z", "A").otherwise(F.char(F.ascii(last) + 1)))
    swapped = lone.filter("p is not null")
    return (
        ringed.unionByName(swapped.select("kind", F.col("p.new").alias("new"), F.col("own").alias("canon")))
        .unionByName(swapped.select("kind", F.col("own").alias("new"), F.col("p.canon").alias("canon")))
        .unionByName(lone.filter("p is null").select("kind", moved.alias("new"), F.col("own").alias("canon")))
    )


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new) for distinct (kind, canon); all new of a kind differ from each other and from their own canon, and from every canon as far as the format has room."""
    pending, done = entities.withColumn("nonce", F.lit(0)), []
    for _ in range(ROUNDS):
        drawn = stored(pending.withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("nonce"), key)), "drawn")
        taken = reduce(DataFrame.unionByName, (d.select("kind", "new") for d in done), entities.select("kind", F.col("canon").alias("new")))
        first = drawn.join(taken, ["kind", "new"], "left_anti").groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        good = stored(first, "assigned")
        done.append(good)
        pending = drawn.join(good, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("nonce") + 1).alias("nonce"))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
    done = reduce(DataFrame.unionByName, done)
    rest = stored(_ring(pending, done, key), "ring")
    return done.join(rest, ["kind", "canon"], "left_anti").select("kind", "new", "canon").unionByName(rest)


def occurrences(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, more, i (from 0), entity, kind, canon of each distinct (id, text); more is the pattern of the text's own names."""
    found = docs.filter(text_of(text).rlike(HINT)).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("t"))
    typed = F.transform("ents", lambda e, i: F.struct(e.alias("entity"), _kind(i).alias("kind")))
    found = split_up(found, "t", "doc_id", "text_hash", "t").filter(F.size("ents") > 0).select("doc_id", "text_hash", "t", typed.alias("x"))
    found = found.withColumn("named", F.array_distinct(F.filter("x", lambda x: x["kind"].isin(*NAMES) & (F.length(x["entity"]) > 1))))
    found = stored(found.withColumn("t", F.when(F.size("named") > 0, F.col("t"))), "found")
    # the longest first, so that of "Smith-Jones" and "Smith" the whole is found
    words = F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct("named.entity"), lambda e: F.struct(F.length(e).alias("n"), e.alias("e"))))), lambda x: x["e"])
    again = found.filter(F.size("named") > 0).withColumn("more", F.concat(F.lit("|(?<![\\p{L}\\p{N}])(?:"), F.array_join(words, "|"), F.lit(")(?![\\p{L}\\p{N}])")))
    pattern = F.concat(F.lit(ALL), "more")
    again = again.select("doc_id", "text_hash", "more", "named", F.split("t", pattern, -1).alias("segs"), F.regexp_extract_all("t", pattern, F.lit(0)).alias("ents"))
    again = again.select("doc_id", "text_hash", "more", F.transform("ents", lambda e, i: F.struct(e.alias("entity"), _kind(i, F.col("named")).alias("kind"))).alias("x"))
    found = found.filter(F.size("named") == 0).select("doc_id", "text_hash", F.lit("").alias("more"), "x").unionByName(again)
    found = found.select("doc_id", "text_hash", "more", F.posexplode_outer("x").alias("i", "x")).select("doc_id", "text_hash", "more", "i", "x.entity", "x.kind")
    return found.withColumn("canon", canonical(F.col("kind"), F.col("entity"))).distinct()


def pseudonymised(docs: DataFrame, key: str = "quern", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The document rows with text replaced and n_entities added (with a leading underscore where that name is taken)."""
    count, id_, hash_, new_, segs, more = fresh(docs, "n_entities", "id_", "hash_", "new_", "segs_", "more_")
    with scratch(docs.sparkSession) as own:
        seen = stored(occurrences(docs, text, id_col), "occurrences")
        names = assigned(seen.select("kind", "canon").distinct(), key)
        new = seen.join(names, ["kind", "canon"]).select("doc_id", "text_hash", "more", "i", rendered(F.col("kind"), F.col("entity"), F.col("new")).alias("new"))
        new = new.groupBy("doc_id", "text_hash", "more").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias(new_))
        new = own.kept(new.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("more").alias(more), new_), "replacements")
    replaced = F.col(new_).isNotNull()
    pieces = F.when(F.col(more) == "", F.split(F.col(text), ALL, -1)).otherwise(F.split(F.col(text), F.concat(F.lit(ALL), F.col(more)), -1))
    right = F.size(segs) == F.size(new_) + 1
    joined = F.when(right, F.array_join(F.flatten(F.zip_with(segs, new_, lambda s, e: F.array(s, F.coalesce(e, F.lit(""))))), "")).otherwise(F.raise_error(F.lit("segments and entities differ")).cast("string"))

    def joined_to(rows: DataFrame, new: DataFrame) -> DataFrame:
        both = rows.join(new, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_of(text)) == F.col(hash_)), "left").withColumn(segs, F.when(replaced, pieces))
        return both.select(*(F.when(replaced, joined).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns), F.when(replaced, F.size(new_)).otherwise(0).cast("long").alias(count))

    if new.count() <= BROADCAST_ROWS:
        return joined_to(docs, F.broadcast(new))
    # beyond that only texts that may hold an entity are shuffled
    hint = text_of(text).rlike(HINT)
    return docs.filter(~hint).withColumn(count, F.lit(0).cast("long")).unionByName(joined_to(docs.filter(hint), new))
