"""Quality rules, line first.

Every line is judged by itself: navigation, boilerplate and punctuation rules. Lines
that fail are removed; a document that loses too much of its text is rejected. Counts
for the document-level base rules come from the whole text as it was.

All of it is built-in expressions over the row's own arrays: nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.llm.tables import SEPARATORS, WORD, let, unused, words_of

# The document-level base rules.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3

# Line rules.
MAX_LOST = 0.5
NAVIGATION_MARK = "[|>»›•·]+"
BOILERPLATE = (
    r"(?i)\b(?:javascript|cookies?|privacy policy|terms of (?:use|service)|all rights reserved|"
    r"subscribe (?:now|to)|sign (?:in|up)|log ?in|click here|read more|share (?:this|on)|lorem ipsum|"
    r"alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|hier klicken|weiterlesen|"
    r"jetzt abonnieren|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|mentions l[éÉ]gales|"
    r"cliquez ici|lire la suite|se connecter|todos los derechos reservados|pol[íÍ]tica de privacidad|"
    r"aviso legal|haga clic aqu[íÍ]|leer m[áÁ]s|iniciar sesi[óÓ]n)(?:[^\w]|\z)"
)
BOILERPLATE_MAX_WORDS = 20
SHOUTED_WORD = "[!?]{2,}"
END_MARK = r"[.!?:;…。！？\"'”’»)\]|][\x20\x09\x0B-\x0D]*\z"
SHORT_LINE_WORDS = 4
# A short line of one of these forms is a list item, a heading, or indented or ends like code.
SHORT_BUT_KEPT = (
    r"^(?:[\x20\x09]*(?:[-*+•–]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])[\x20\x09]+[^\x20\x09-\x0D]"
    r"|#{1,6}[\x20\x09]+[^\x20\x09-\x0D]"
    r"|(?:\x20\x20|\x09)[\x20\x09]*[A-Za-z_@(){}])"
    r"|[{}(;,=][\x20\x09\x0B-\x0D]*\z"
)


def _matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _at_least(line: Column, n: int) -> Column:
    """Has the line ``n`` words or more? Reads no further than the last of them."""
    word, space = f"[^{SEPARATORS}]", f"[{SEPARATORS}]"
    return line.rlike(f"^{space}*+(?:{word}++{space}++){{{n - 1}}}{word}")


def line_passes(line: Column) -> Column:
    """False for a line that is navigation, boilerplate or badly punctuated.

    Navigation: separator marks standing alone, at least two and one for every four
    words. Boilerplate: a short line with a stock phrase. Punctuation: doubled
    exclamation or question marks on every other word, as many symbols as words (and
    four at least), or a line of fewer than four words that doesn't end like a sentence
    and is no list item, marked heading or code.

    The line must hold a word. Words are counted only where a rule's other half holds.
    """
    stop = f"(?![^{SEPARATORS}])"
    words = _matches(line, WORD)
    marks = _matches(line, f"(?={NAVIGATION_MARK})(?<![^{SEPARATORS}]){NAVIGATION_MARK}{stop}")
    shouted = _matches(line, f"{SHOUTED_WORD}{stop}")
    symbols = _matches(line, SYMBOLS)
    navigation = line.rlike(NAVIGATION_MARK) & let(marks, lambda n: (n >= 2) & (n * 4 >= words))
    boilerplate = ~_at_least(line, BOILERPLATE_MAX_WORDS + 1) & line.rlike(BOILERPLATE)
    shouting = let(shouted, lambda n: (n >= 1) & (n * 2 >= words))
    noise = let(symbols, lambda n: (n >= SHORT_LINE_WORDS) & (n >= words))
    fragment = (
        ~_at_least(line, SHORT_LINE_WORDS) & ~line.rlike(END_MARK) & ~line.rlike(SHORT_BUT_KEPT)
    )
    return ~(navigation | boilerplate | shouting | noise | fragment)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words lying in a window of ``window`` words that the text holds at least twice.

    Windows are hashed; the hash's low 33 bits and the position are packed into one
    number each, and after a sort equal hashes are neighbours. Those windows are
    candidates only: they are then compared by their words.
    """

    def packed(ws: Column) -> Column:
        def one(i: Column) -> Column:
            parts = [F.get(ws, i + k) for k in range(window)]
            return F.shiftleft(F.xxhash64(*parts), 31).bitwiseOR(i.cast("long"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - window), one))

    def neighbours_agree(items: Column, part) -> Column:
        def agrees(x: Column, i: Column) -> Column:
            return F.coalesce(part(x) == part(F.get(items, i - 1)), F.lit(False)) | F.coalesce(
                part(x) == part(F.get(items, i + 1)), F.lit(False)
            )

        return F.filter(items, agrees)

    def candidates(sorted_: Column) -> Column:
        return F.transform(
            neighbours_agree(sorted_, lambda x: F.shiftrightunsigned(x, 31)),
            lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"),
        )

    def verified(ws: Column, found: Column) -> Column:
        windows = F.sort_array(
            F.transform(
                found,
                lambda p: F.struct(F.slice(ws, p + 1, F.lit(window)).alias("w"), p.alias("p")),
            )
        )
        return F.sort_array(
            F.transform(let(windows, lambda s: neighbours_agree(s, lambda x: x["w"])), lambda x: x["p"])
        )

    def covered(places: Column) -> Column:
        def new_words(p: Column, k: Column) -> Column:
            return F.least(F.lit(window), F.coalesce(F.get(places, k + 1), p + window) - p)

        return F.aggregate(F.transform(places, new_words), F.lit(0), lambda a, x: a + x)

    def count(ws: Column) -> Column:
        def from_candidates(found: Column) -> Column:
            return F.when(F.size(found) < 2, 0).otherwise(let(verified(ws, found), covered))

        return F.when(F.size(ws) < window + 1, 0).otherwise(
            let(let(packed(ws), candidates), from_candidates)
        )

    return let(words, count).cast("long")


def judged(
    docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST, name: str = "quality"
) -> DataFrame:
    """``docs`` with the struct column ``name`` added (one of that name is replaced).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed;
    n_lines and n_lines_removed (lines with a word), lost_share (of characters in
    words), clean_text (lines that passed, in order) and kept.

    A null text has no words: all counts are 0, clean_text is empty and the document
    isn't kept. The same row always gets the same answer, however often it appears.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    space = F.lit(f"[{SEPARATORS}]+")

    def in_words(value: Column) -> Column:
        return F.length(F.regexp_replace(value, space, F.lit("")))

    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    seen = F.struct(
        let(
            words_of(whole),
            lambda ws: F.struct(
                F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("repeated")
            ),
        ).alias("words"),
        in_words(whole).cast("long").alias("word_chars"),
        _matches(whole, SYMBOLS).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda ls: F.struct(
                F.size(ls).alias("n"),
                F.size(F.array_distinct(ls)).alias("different"),
                F.filter(ls, line_passes).alias("good"),
            ),
        ).alias("lines"),
    )

    def verdict(q: Column) -> Column:
        n_words, repeated = q["words"]["n"], q["words"]["repeated"]
        clean = F.array_join(q["lines"]["good"], "\n")
        failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n_words)
        lost = F.when(q["word_chars"] > 0, 1 - in_words(clean) / q["word_chars"]).otherwise(F.lit(1.0))
        return F.struct(
            n_words.alias("n_words"),
            q["word_chars"].alias("word_chars"),
            q["n_symbols"].alias("n_symbols"),
            (q["lines"]["n"] - q["lines"]["different"]).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            failed.alias("base_failed"),
            q["lines"]["n"].cast("long").alias("n_lines"),
            (q["lines"]["n"] - F.size(q["lines"]["good"])).cast("long").alias("n_lines_removed"),
            lost.alias("lost_share"),
            clean.alias("clean_text"),
            (~failed & (lost <= max_lost)).alias("kept"),
        )

    # One expression, so that the optimiser has nothing to compute twice.
    others = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.select(*others, let(seen, verdict).alias(name))


def cleaned(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The documents kept, their failing lines removed; other columns as they were.

    Null and wordless texts are not kept. Rows are independent of each other, so equal
    rows stay or go together. An empty table gives no rows."""
    # Exploding, not filtering: a filter would be pushed down and judge every text again.
    seen, one = unused(docs, "_seen"), unused(docs, "_one")
    kept = F.filter(F.array(seen), lambda q: q["kept"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = judged(docs, text, max_lost, seen).select(*columns, F.explode(kept).alias(one))
    clean = F.col(one)["clean_text"].alias(text)
    return rows.select(*[clean if c == text else F.col(f"`{c}`") for c in docs.columns])
