r"""Operator 8: line-first cleaning, in DataFrame functions only.

Every line with a word is judged by three rules; a line that fails one is
removed, and a document that loses more than ``max_lost`` of its word
characters is rejected.

* punctuation: over ``symbol_share`` of the line's word characters are marks
  that prose hardly has, over half of its words (four or more) end in doubled
  marks, or it has no letter and no digit at all;
* navigation: over a quarter of its words (four or more) are separators, or
  it holds menu words and separators only;
* boilerplate: it holds a fixed phrase of licences, cookie notices and the like,
  in English, French, German or Spanish.

Beside the verdict stand the base counters of the whole text.  Words that recur
in three-word windows are found inside the row: windows are hashed, sorted with
their places, and the places of equal neighbours are laid out again.  That is
n log n in the length of a text and needs no shuffle.

Null and empty texts have no words: all counters are zero and the base rule
fails.  A text without failing lines loses nothing.  Repeated rows are judged
each on its own.  A very long text is judged in its row, n log n in its words.
Extra columns pass through; a clashing name gets an underscore.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, firm, fresh

MIN_WORDS = 50
MAX_REPEAT = 50           # per cent of words in recurring windows
MAX_LOST = 0.5
SYMBOL_SHARE = 0.2

# The symbols of the base rule, and what marks a line.
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>~^=_{}\\\\@+"
ANY_MARK = r"[#*$%&|<>~^=_{}\\@+»›·•/-]|[!?.,][!?.,]"
MENU_WORDS = (
    # English
    "home", "main menu", "menu", "log in", "login", "sign in", "sign up", "register", "search", "next", "previous", "back to top",
    "skip to content", "skip to main content", "share", "share this", "tweet", "follow us", "subscribe", "site map", "sitemap", "contact",
    "contact us", "about", "about us", "categories", "tags", "archives", "news", "more", "help", "faq",
    # French
    "accueil", "connexion", "se connecter", "s'inscrire", "rechercher", "recherche", "suivant", "précédent", "retour en haut", "partager",
    "plan du site", "à propos", "actualités", "aide",
    # German
    "startseite", "anmelden", "registrieren", "suche", "weiter", "zurück", "nach oben", "teilen", "inhalt", "kontakt", "impressum",
    "über uns", "hilfe",
    # Spanish
    "inicio", "iniciar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver arriba", "compartir", "mapa del sitio",
    "contacto", "acerca de", "noticias", "ayuda",
)
PHRASE_PATTERNS = (
    # English
    "all rights reserved", r"copyright \(c\)", "this work is licensed", "licen[cs]ed under (the|a|an|cc|creative|mit|apache|gnu|gpl|bsd) ",
    "(released|published|distributed) under (the |a |an )?[a-z0-9 .-]*licen[cs]e", "permission is hereby granted", "terms of (use|service)",
    "privacy policy", "cookie policy", "uses cookies", "accept (all )?cookies", "powered by", "subscribe to our", "sign up for",
    "follow us on", "enable javascript", "lorem ipsum", "click here", "read more",
    # French
    "tous droits réservés", "sous (la )?licence", "conditions (générales )?d.utilisation", "politique de confidentialité", "utilise des cookies",
    "accepter (tous )?les cookies", "propulsé par", "abonnez-vous", "inscrivez-vous", "suivez-nous", "cliquez ici", "lire la suite", "mentions légales",
    # German
    "alle rechte vorbehalten", "lizenziert unter", "unter (der|einer) [a-z0-9 .-]*lizenz", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies",
    "cookies akzeptieren", "folgen sie uns", "klicken sie hier", "hier klicken", "weiterlesen", "mehr erfahren",
    # Spanish
    "todos los derechos reservados", "bajo (la )?licencia", "(términos|condiciones) de uso", "política de (privacidad|cookies)", "utiliza cookies",
    "aceptar (todas las )?cookies", "suscríbete", "suscríbase", "síguenos", "ha(ga|z) clic aquí", "leer más",
)
GAP = rf"[{SPACE_CLASS}|>»›·•/:,-]+"
# the longest first, and two blanks between words: see _menu
_MENU_ITEMS = "|".join(w.replace(" ", "  ") for w in sorted(MENU_WORDS, key=lambda w: (-len(w), w)))
MENU_START = rf"^({GAP})?({'|'.join(w.replace(' ', GAP) for w in MENU_WORDS)})({GAP}|$)"
MENU_ITEM = f" ({_MENU_ITEMS}) "
# a phrase begins where no letter stands before it, so most places are passed at once
PHRASES = rf"(^|[^\p{{L}}])({'|'.join(PHRASE_PATTERNS)})"
SIGN = "©"


def _words(col: Column) -> Column:
    return F.filter(F.split(col, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def _marked(line: Column) -> Column:
    """Fails for its marks, doubled marks or separators."""
    bare = F.regexp_replace(line, f"[{SPACE_CLASS}]+", "")
    marks = F.length(bare) - F.length(F.translate(bare, MARKS, ""))
    n = F.size(_words(line))
    doubled = F.size(F.regexp_extract_all(line, F.lit(r"[!?.,*#%$&]{2,}(?=\s|$)"), F.lit(0)))
    separators = F.size(F.regexp_extract_all(line, F.lit(r"(?<=\s|^)[|»›·•>/-]+(?=\s|$)"), F.lit(0)))
    return (marks > F.length(bare) * SYMBOL_SHARE) | ((n >= 4) & ((doubled * 2 > n) | (separators * 4 > n)))


def _menu(line: Column) -> Column:
    """Whether nothing is left when menu words go, each with a blank on either side."""
    low = F.lower(line)
    spaced = F.concat(F.lit(" "), F.regexp_replace(low, GAP, "  "), F.lit(" "))
    return low.rlike(MENU_START) & (F.trim(F.regexp_replace(spaced, MENU_ITEM, "")) == "")


def _phrase(text: Column) -> Column:
    return text.contains(SIGN) | F.lower(text).rlike(PHRASES)


def _bad_line(marks: Column, phrases: Column, line: Column) -> Column:
    """Whether a line fails; what no line of its text can hold isn't looked for
    (``marks``: the text has any mark, ``phrases``: any phrase)."""
    return (~line.rlike(r"[\p{L}\p{N}]") | _menu(line) | (marks & _marked(line))
            | (phrases & _phrase(line)))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
          max_lost: float = MAX_LOST, cleaned: bool = False) -> DataFrame:
    """``keep`` columns (default: all) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, lost_chars (word characters in
    failing lines) and kept; with ``cleaned``, the text without those lines."""
    keep = docs.columns if keep is None else keep
    t, words, lines, sorted_, places, marks, phrases, bad = (
        fresh(docs.columns, c) for c in ("_t", "_words", "_lines", "_grams", "_places", "_marks", "_phrases", "_bad"))
    d = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(words, firm(_words(F.col(t))))
    # hash of each window with its place, sorted: equal windows stand together
    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    d = d.withColumn(sorted_, firm(grams))
    d = d.withColumn(marks, F.col(t).rlike(ANY_MARK)).withColumn(phrases, firm(_phrase(F.col(t))))
    no_longs = F.array().cast("array<int>")
    repeated = F.size(F.array_distinct(sorted_)) < F.size(sorted_)
    d = d.withColumn(sorted_, firm(F.when(repeated, F.sort_array(F.transform(sorted_, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    # (window, the one before, the one after): in place if it equals either
    ahead = F.slice(sorted_, 2, F.size(sorted_))
    marked = F.zip_with(sorted_, ahead, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), b["i"].alias("j"), (a["h"] == b["h"]).alias("same")))
    d = d.withColumn(places, firm(F.when(F.col(sorted_).isNull(), no_longs).otherwise(
        F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(marked, lambda x: x["same"]), lambda x: F.array(x["i"], x["j"]))))))))
    nexts = F.slice(places, 2, F.size(places))
    covered = F.aggregate(F.zip_with(places, nexts, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
                          F.lit(0).cast("long"), lambda acc, x: acc + x)
    d = d.withColumn(lines, firm(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))))
    flat = f"[{SPACE_CLASS}]+"

    def fails(line):
        return _bad_line(F.col(marks), F.col(phrases), line)

    d = d.withColumn(bad, firm(F.filter(lines, fails)))
    n_words = F.size(words).cast("long")
    new = {
        "n_words": firm(n_words),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered,
        "lost_chars": F.length(F.regexp_replace(F.array_join(bad, ""), flat, "")).cast("long"),
    }
    if cleaned:
        # equal lines fare alike, so those that fail need not be judged again
        new["cleaned"] = F.when(F.size(bad) == 0, F.col(t)).otherwise(
            F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.array_contains(bad, x)), "\n"))
    taken = [*keep]
    names = {}
    for c in [*new, "base_failed", "kept"]:
        names[c] = fresh(taken, c)
        taken.append(names[c])
    inner = d.select(*[d[c] for c in keep], *[v.alias(names[c]) for c, v in new.items()])
    n, rep = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    inner = inner.withColumn(names["base_failed"], (n < MIN_WORDS) | (rep * 100 > n * MAX_REPEAT))
    lost = F.col(names["lost_chars"]) > F.col(names["word_chars"]) * max_lost
    return inner.withColumn(names["kept"], ~F.col(names["base_failed"]) & ~lost)


def keep_good(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST, length: str | None = None) -> DataFrame:
    """The documents that are kept, without their failing lines; the column
    ``length``, if there is one, follows where lines went.  Other columns stay."""
    judged = judge(docs, text, max_lost=max_lost, cleaned=True)
    added = judged.columns[len(docs.columns):]
    cleaned, kept = F.col(added[6]), F.col(added[-1])
    shorter = F.length(cleaned) < F.length(F.col(text))
    new = {text: F.when(shorter, cleaned).otherwise(F.col(text))}
    if length in docs.columns:
        new[length] = F.when(shorter, F.length(cleaned)).otherwise(F.col(length)).cast(docs.schema[length].dataType)
    return judged.where(kept).select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
