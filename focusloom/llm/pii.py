"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

One pattern finds e-mail addresses, secrets, national ids, IP addresses, card
and phone numbers (in any script's digits; cards only with a right check digit),
and names after a form of address. Texts are searched once: the rows and what was
found in them are written to the shared folder, and all else reads that. Each entity's surrogate is
drawn from a keyed hash of its canonical form (lower case; digits only for
numbers), so an entity has one surrogate in all documents however it is written;
first names (with the gender of their form of address) and surnames are drawn
apart, so all forms of a name agree, and where they stand alone in the same text they are replaced too;
letters stay letters of their case, digits digits of their script, signs where
they were, card numbers keep a right check digit, private addresses stay private
and public ones public, and names keep script and the gender of their form of address.

Collision check: the surrogates of all distinct entities are compared with each
other and with the entities themselves; where two would meet, all but the first
are drawn again with the next attempt's hash, until none meet.

Defined cases: null texts stay null; texts without entities stay as they are;
repeated rows are treated alike; an entity that only differs in case or grouping
is the same one; columns are kept as they come, also ones with odd names; an empty
table gives an empty one.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import discard, materialize

#: The default key; give your own, and keep it secret.
KEY = "focusloom"
#: Draws in the shape of an entity; after them addresses grow, and the last one gives up.
ATTEMPTS, LAST = 8, 64

#: Decimal digits of all scripts, ten in a row for each.
DIGITS = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Nd")
_D = r"[\p{Nd}&&[^\x{10000}-\x{10FFFF}]]"
# The patterns of entities, the first that matches wins. None tries a run of letters again from within.
PATTERNS = {
    "email": r"(?:(?<![\p{L}\p{N}._%+\-])|\G)[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-][\p{L}\p{N}\-.]*\.\p{L}{2,}",
    "secret": r"\b(?:sk-[A-Za-z0-9_\-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AKIA[A-Z0-9]{16}|AIza[A-Za-z0-9_\-]{30,}|[0-9a-f]{32,64}|[0-9A-F]{32,64})\b",
    "national_id": rf"(?<![\p{{N}}\-]){_D}{{3}}-{_D}{{2}}-{_D}{{4}}(?![\p{{N}}\-])",
    "ipv4": r"(?<![\p{N}.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\p{N}]|\.[0-9])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "card": rf"(?<!{_D})(?:{_D}[ \-]?){{12,18}}{_D}(?!{_D})",
    "phone": rf"(?<![\p{{L}}\p{{N}}])(?:\+{_D}{{1,3}}[ .\-]?)?(?:\({_D}{{2,4}}\)[ .\-]?|{_D}{{2,4}}[ .\-]){_D}{{3,4}}[ .\-]{_D}{{3,4}}(?![\p{{L}}\p{{N}}])",
    "name": r"\b(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Where a word begins or ends.
_EDGE = r"(?<=[\p{L}\p{M}\p{N}_])(?![\p{L}\p{M}\p{N}_])|(?<![\p{L}\p{M}\p{N}_])(?=[\p{L}\p{M}\p{N}_])"
# Forms of address for women, and surrogate names by gender and script.
FEMALE = r"^(?:Mrs|Ms|Frau|Madame|Mme|Señora|Sra|Госпожа)\b"
NAMES = {
    ("f", "latin"): ("Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna", "Irma", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula", "Rita", "Sonja", "Tilda", "Vera"),
    ("m", "latin"): ("Albert", "Bruno", "Conrad", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oskar", "Paul", "Robert", "Simon", "Tomas", "Viktor"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лидия", "Мария"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим"),
}
_SYLLABLES = ("ba", "do", "fe", "gi", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "ze")
_CYRILLIC = ("ба", "до", "фе", "ги", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ва", "зе")


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed([*PATTERNS.items()][:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What makes two spellings the same entity."""
    digits = F.regexp_replace(F.translate(entity, DIGITS, "0123456789" * (len(DIGITS) // 10)), "[^0-9]", "")
    return F.when(kind.isin("card", "phone", "national_id"), digits).when(kind == "name", F.trim(entity)).otherwise(F.lower(entity))


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Hex digits enough for any entity: four keyed hashes in a row (repeated for longer ones)."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(f"{key}\x1f{i}"), kind, canon, attempt.cast("string")), 512) for i in range(2)]
    return F.concat(*parts)


def _hex(stream: Column, at: Column, n: int) -> Column:
    """The number in n hex digits of the stream at a 0-based position."""
    return F.conv(F.substr(stream, F.pmod(at * 3, F.lit(256 - n)) + 1, F.lit(n)), 16, 10).cast("int")


def _digit_like(c: Column, digit: Column) -> Column:
    """A digit (an integer) as the script of the digit c writes it."""
    at = F.instr(F.lit(DIGITS), c)  # of the digit in c, from 1
    return F.when(at > 0, F.substr(F.lit(DIGITS), at - F.pmod(at - 1, F.lit(10)) + digit, F.lit(1))).otherwise(digit.cast("string"))


def _swap(text: Column, stream: Column, hexes: bool = False) -> Column:
    """Each digit for a digit, each letter for a letter of its case and alphabet."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    russian = F.lit("абвгдежзиклмнопрстуфхцчшэюя")
    greek = F.lit("αβγδεζηθικλμνξοπρστυφχψω")

    def one(c: Column, i: Column) -> Column:
        n = _hex(stream, i, 3)
        low = F.lower(c)
        pick = lambda pool, size: F.substr(pool, F.pmod(n, F.lit(size)) + 1, F.lit(1))
        letter = F.when(low.rlike(r"^[\p{IsCyrillic}]$"), pick(russian, 27)).when(low.rlike(r"^[\p{IsGreek}]$"), pick(greek, 24)).otherwise(pick(letters, 6 if hexes else 26))
        return F.when(c.rlike(rf"^{_D}$"), _digit_like(c, F.pmod(n, F.lit(10)).cast("int"))).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum of all digits, modulo 10, doubling every second from the right."""
    return F.pmod(
        F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") * 2 / 10).cast("int"))), F.lit(0), lambda a, x: a + x),
        F.lit(10),
    )


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a canonical entity (digits only for numbers; lower case for addresses and secrets).

    A surname is a kind of its own, and so is a first name, written f|Anna or
    m|Karl. Both get a syllable more with each attempt, so their number grows as needed.
    """
    stream = _stream(key, kind, canon, attempt)
    swapped = _swap(canon, stream)
    # the last label of a domain stays
    more = F.when(attempt >= ATTEMPTS, F.substr(stream, F.lit(1), attempt - (ATTEMPTS - 1))).otherwise(F.lit(""))
    email = F.concat(more, _swap(F.regexp_replace(canon, r"\.[^.@]+$", ""), stream), F.regexp_extract(canon, r"\.[^.@]+$", 0))
    octet = lambda i: F.pmod(_hex(stream, F.lit(i), 4), F.lit(254)).cast("int") + 1
    ten, public = F.concat_ws(".", F.lit("10"), octet(1)), [n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203)]
    of_old = lambda pattern, new: F.when(canon.rlike(pattern), F.when(attempt < ATTEMPTS, new).otherwise(ten))
    head = F.coalesce(
        F.when(canon.rlike(r"^10\."), ten), of_old(r"^192\.168\.", F.lit("192.168")), of_old(r"^172\.(?:1[6-9]|2[0-9]|3[01])\.", F.concat(F.lit("172."), (F.pmod(_hex(stream, F.lit(1), 4), F.lit(16)) + 16).cast("string"))),
        F.when(canon.rlike(r"^127\."), F.concat_ws(".", F.lit("127"), octet(1))), F.concat_ws(".", F.get(F.array(*map(F.lit, public)), F.pmod(_hex(stream, F.lit(0), 4), F.lit(len(public)))), octet(1)),
    )
    ip = F.concat_ws(".", head, octet(2), octet(3))
    # the first two signs tell an address's scope
    ip6 = F.concat(F.substr(canon, F.lit(1), F.lit(2)), _swap(F.substr(canon, F.lit(3)), stream, hexes=True))
    # the issuer's digit stays, and the check digit is right
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(swapped, F.lit(2), F.length(canon) - 2))
    card = F.concat(body, F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    phone = F.concat(F.when(F.length(canon) > 10, F.substr(canon, F.lit(1), F.length(canon) - 10)).otherwise(F.lit("")), F.substr(swapped, F.greatest(F.length(canon) - 9, F.lit(1)), F.lit(10)))
    female, cyrillic = canon.startswith("f|"), canon.rlike(r"\p{IsCyrillic}")
    pool = lambda g, s: F.get(F.array(*map(F.lit, NAMES[g, s])), F.pmod(_hex(stream, F.lit(1), 4), F.lit(len(NAMES[g, s]))))
    first = F.when(cyrillic, F.when(female, pool("f", "cyrillic")).otherwise(pool("m", "cyrillic"))).otherwise(F.when(female, pool("f", "latin")).otherwise(pool("m", "latin")))
    part = lambda pool_, i: F.get(F.array(*map(F.lit, pool_)), F.pmod(_hex(stream, i, 4), F.lit(16)))
    syllables = F.transform(F.sequence(F.lit(0), attempt + 2), lambda j: F.when(cyrillic, part(_CYRILLIC, j * 2 + 3)).otherwise(part(_SYLLABLES, j * 2 + 3)))
    last = F.initcap(F.array_join(syllables, ""))
    first = F.concat(first, F.array_join(F.slice(syllables, F.lit(1), attempt), ""))
    secret = F.concat(F.regexp_extract(canon, r"^(?:sk-|gh._|xox.-|akia|aiza)?", 0), _swap(F.regexp_replace(canon, r"^(?:sk-|gh._|xox.-|akia|aiza)", ""), stream, hexes=True))
    return F.when(kind == "email", email).when(kind == "ipv4", ip).when(kind == "ipv6", ip6).when(kind == "card", card).when(kind == "phone", phone).when(kind == "surname", last).when(kind == "first", first).when(kind == "secret", secret).otherwise(swapped)


def _as_written(kind: Column, entity: Column, drawn: Column) -> Column:
    """A surrogate in the format of one spelling: signs between digits, or case."""
    place = F.aggregate(
        F.split(entity, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike(rf"^{_D}$"), F.struct(F.concat(a["out"], _digit_like(c, F.substr(drawn, a["at"], F.lit(1)).cast("int"))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
    )["out"]
    upper = F.upper(entity)
    return F.when(kind.isin("card", "phone", "national_id"), place).when(entity == F.lower(entity), drawn).when(entity == upper, F.upper(drawn)).otherwise(
        F.array_join(F.transform(F.split(drawn, ""), lambda c, i: F.when(F.substr(entity, i + 1, F.lit(1)) == F.substr(upper, i + 1, F.lit(1)), F.upper(c)).otherwise(c)), "")
    )


def surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, drawn): one distinct surrogate for each distinct entity of found(kind, canon)."""
    entities = materialize(found.select("kind", "canon").distinct(), "entities")
    todo = entities
    rounds = []
    for attempt in range(LAST):
        drawn = materialize(todo.select("kind", "canon", surrogate(key, F.col("kind"), F.col("canon"), F.lit(attempt)).alias("drawn")), "drawn")
        # free: nobody else's, no entity of the corpus, not taken in an earlier round
        mine = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        mine = mine.join(entities.select("kind", F.when(F.col("kind") == "first", F.substring("canon", 3, 1 << 30)).otherwise(F.col("canon")).alias("drawn")), ["kind", "drawn"], "left_anti")
        for earlier in rounds:
            mine = mine.join(earlier.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        rounds.append(materialize(mine.select("kind", "canon", "drawn"), "surrogates"))
        todo = drawn.join(rounds[-1].select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon")
        if todo.isEmpty():
            break
    else:  # numbers of one form, most of which are entities themselves
        raise ValueError(f"no distinct surrogates left for {[r['kind'] for r in todo.select('kind').distinct().collect()]}")
    return reduce(DataFrame.unionByName, rounds)


def genuine(entity: Column) -> Column:
    """Is what the pattern found an entity? Numbers of a card's length with a wrong check digit aren't."""
    kind = kind_of(entity)
    return (kind != "card") | (_luhn(canonical(kind, entity)) == 0)


def found_in(text: Column) -> Column:
    """All that the pattern finds in a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), 0)


def entities_of(found: DataFrame, hits: str = "_hits") -> DataFrame:
    """Distinct (entity, kind, canon) of all arrays of hits."""
    entities = found.select(F.explode_outer(F.array_distinct(hits)).alias("entity")).where("entity is not null").distinct()
    entities = entities.where(genuine(F.col("entity"))).withColumn("kind", kind_of(F.col("entity")))
    return entities.select("entity", "kind", canonical(F.col("kind"), F.col("entity")).alias("canon"))


def _replacements(found: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate, bare) of found(entity, kind, canon); bare: what a name's parts become where they stand alone."""
    name = F.col("kind") == "name"
    gender = F.when(F.col("entity").rlike(FEMALE), "f|").otherwise("m|")
    given = F.regexp_extract("entity", r"^\S+ (\S+) \S+$", 1)
    names = found.where(name).select("entity", F.regexp_extract("entity", r"\S+$", 0).alias("last"), F.when(given != "", given).alias("given"), F.when(given != "", F.concat(gender, given)).alias("first"))
    rest = found.where(~name)
    parts = names.select(F.lit("surname").alias("kind"), F.col("last").alias("canon")).union(names.where("first is not null").select(F.lit("first"), "first"))
    drawn = surrogates(rest.select("kind", "canon").union(parts), key)
    none = F.array().cast("array<struct<word:string,rank:int,new:string>>")
    table = rest.join(drawn, ["kind", "canon"]).select("entity", _as_written(F.col("kind"), F.col("entity"), F.col("drawn")).alias("surrogate"), none.alias("bare"))
    of = lambda kind, old, new: drawn.where(F.col("kind") == kind).select(F.col("canon").alias(old), F.col("drawn").alias(new))
    names = names.join(of("surname", "last", "new_last"), "last").join(of("first", "first", "new_first"), "first", "left")
    one = lambda word, rank, new: F.struct(F.col(word).alias("word"), F.lit(rank).alias("rank"), F.col(new).alias("new"))
    bare = F.when(F.col("first").isNull(), F.array(one("last", 0, "new_last"))).otherwise(F.array(one("last", 0, "new_last"), one("given", 1, "new_first")))
    return table.union(names.select("entity", F.concat_ws(" ", F.regexp_extract("entity", r"^\S+", 0), "new_first", "new_last"), bare))


def pseudonymize(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; all columns as they were, in their order.

    Texts without entities pass straight through; only the others are shuffled,
    to meet their surrogates, by a row number that is written with them.
    """
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    its_text = f"_whole.c{docs.columns.index(text)}"
    marked = docs.select(F.monotonically_increasing_id().alias("_row"), whole.alias("_whole"), found_in(F.col(f"`{text}`").cast("string")).alias("_hits"))
    marked = materialize(marked, "marked").withColumn("_any", F.coalesce(F.exists("_hits", genuine), F.lit(False)))
    as_it_was = [F.col(f"_whole.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    clean = marked.where("not _any").select(*as_it_was)
    hit = marked.where("_any").select("_row", "_whole", "_hits")
    found = materialize(entities_of(hit), "found")
    table = materialize(_replacements(found, key), "replacements")
    discard(found)
    parts = hit.select("_row", F.explode(F.array_distinct("_hits")).alias("entity")).join(table, "entity")
    mapped = parts.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_map"), F.array_sort(F.flatten(F.collect_list("bare"))).alias("_bare"))
    # a word that is a surname and a first name in one text is taken for the surname
    mapped = mapped.withColumn("_bare", F.expr("map_from_entries(transform(filter(_bare, (x, i) -> i = 0 or get(_bare, i - 1).word <> x.word), x -> struct(x.word, x.new)))"))
    joined = hit.join(mapped, "_row", "left")  # no row goes, whatever is found
    gaps = F.split(F.col(its_text).cast("string"), ANY, -1)
    alone = lambda g: F.when(F.coalesce(F.size("_bare"), F.lit(0)) < 1, g).otherwise(F.array_join(F.transform(F.split(g, _EDGE, -1), lambda w: F.coalesce(F.try_element_at(F.col("_bare"), w), w)), ""))
    new = lambda h: F.coalesce(F.try_element_at(F.col("_map"), h), F.when(genuine(h), F.lit("[removed]")).otherwise(h))
    out = F.array_join(F.zip_with(gaps, "_hits", lambda g, h: F.concat(alone(g), F.when(h.isNull(), F.lit("")).otherwise(new(h)))), "")
    replaced = joined.withColumn("_new", out).select(*(F.col("_new").alias(c) if c == text else old for c, old in zip(docs.columns, as_it_was)))
    return clean.unionByName(replaced)
