"""Quality rules, line first: punctuation, navigation and boilerplate rules judge each
line, failing lines are removed, and a document that loses too much text is rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import binaries, ngram_hashes, nulls_to_empty, split_words, word_hashes

_SEPARATORS = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_TERMINAL = tuple(x.encode() for x in (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "…", "»", "”", "’"))
#: Phrases of page furniture in the corpus's languages, as patterns over text in lower case.
PHRASES = {
    "en": "cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|javascript is disabled|"
          "subscribe to our newsletter|sign in|log in|skip to (?:main )?content|lorem ipsum|share on (?:facebook|twitter)|click here",
    "de": "cookie-richtlinie|datenschutzerklärung|allgemeine geschäftsbedingungen|alle rechte vorbehalten|javascript aktivieren|"
          "newsletter abonnieren|jetzt anmelden|zum inhalt springen|auf (?:facebook|twitter) teilen|hier klicken",
    "fr": "politique de confidentialité|conditions d(?:'|’)utilisation|tous droits réservés|activer javascript|"
          "abonnez-vous à notre newsletter|se connecter|aller au contenu|partager sur (?:facebook|twitter)|cliquez ici",
    "es": "política de (?:cookies|privacidad)|términos de (?:uso|servicio)|todos los derechos reservados|activar javascript|"
          "suscríbete a nuestro boletín|iniciar sesión|saltar al contenido|compartir en (?:facebook|twitter)|haz clic aquí",
}
_BOILERPLATE = re.compile("|".join(PHRASES.values()).encode(), re.IGNORECASE)  # ASCII letters in either case
_NAVIGATION = re.compile(rb"\||>{1,2}|\xc2\xbb|\xe2\x80\xba|\xc2\xb7|\xe2\x80\xa2")


@dataclass(frozen=True)
class LineRules:
    """``max_symbols``: share of a line's characters that may be symbols.  ``nav_words``: a
    line of so few words without closing punctuation is navigation, as is one with
    ``nav_marks`` menu marks.  ``boiler_words``: a boilerplate phrase counts in lines of up
    to so many words.  ``max_lost``: share of the word characters that a document may lose."""

    max_symbols: float = 0.3
    nav_words: int = 2
    nav_marks: int = 3
    boiler_words: int = 25
    max_lost: float = 0.5


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUATION))


def line_failure(line: bytes, rules: LineRules) -> str | None:
    """The rule that a line with words fails, or None."""
    words = split_words(line)
    n_chars = sum(map(code_points, words))
    n_symbols = len(line) - len(line.translate(None, _SYMBOLS))
    if n_symbols > rules.max_symbols * n_chars:
        return "punctuation"
    if len(words) <= rules.nav_words and not line.rstrip().endswith(_TERMINAL):
        return "navigation"
    if len(_NAVIGATION.findall(line)) >= rules.nav_marks:
        return "navigation"
    if len(words) <= rules.boiler_words and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def text_figures(data: bytes, rules: LineRules) -> dict:
    """All counts of one text.  No text, or none but separators, gives zeros and is rejected."""
    word_chars = len(data.translate(None, _CONTINUATION + _SEPARATORS))
    n_words, seen, n_dup, lost, kept = len(split_words(data)), set(), 0, 0, []
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in data.split(b"\n"):
        if not line.strip():
            continue
        n_dup += line in seen
        seen.add(line)
        if why := line_failure(line, rules):
            failed[why] += 1
            lost += len(line.translate(None, _CONTINUATION + _SEPARATORS))
        else:
            kept.append(line)
    grams = ngram_hashes(word_hashes(data), 3)
    n_repeat = 0
    if len(grams):
        _, which, count = np.unique(grams, return_inverse=True, return_counts=True)
        covered = np.zeros(n_words, dtype=bool)
        at = np.flatnonzero(count[which] > 1)
        for k in range(3):
            covered[at + k] = True
        n_repeat = int(covered.sum())
    base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": len(data) - len(data.translate(None, _SYMBOLS)),
        "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.max_lost * word_chars,
        "n_failed_punctuation": failed["punctuation"], "n_failed_navigation": failed["navigation"],
        "n_failed_boilerplate": failed["boilerplate"], "lost_chars": lost, "clean_text": b"\n".join(kept),
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row for each row of ``docs``: its figures, ``base_failed``, ``kept`` and the text of
    the lines that pass (``clean_text``; left out without ``with_text``).

    A null or empty text has no words and is rejected.  Repeated rows are judged each for
    itself, other columns are not read, and an empty table gives an empty table.  One
    narrow pass: nothing is shuffled, and a task holds one Arrow batch at a time."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_failed_punctuation", "n_failed_navigation", "n_failed_boilerplate", "lost_chars"]
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type)] + [T.StructField(c, T.LongType()) for c in longs]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in more]
        + ([T.StructField("clean_text", T.StringType())] if with_text else []))
    names = schema.names[1:]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.binary()}
        for batch in batches:
            figures = [text_figures(nulls_to_empty(x.as_py()), rules) for x in binaries(batch.column(1))]
            columns = [pa.array([f[c] for f in figures], kinds.get(c, pa.int64())) for c in names]
            if with_text:
                columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(judge, schema)
