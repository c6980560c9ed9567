"""Token extraction for search, grounding and claim matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidencia.functions.binding import let

# Words that never count as distinctive evidence for a query.
BOILERPLATE_WORDS = """
trial trials clinical phase mechanism mechanisms oncology cancer drug drugs patient patients study
studies treatment therapy compare compared comparing involving action target targets best recipe
table sponsor sponsors showing names database questions related answer about which
safety efficacy tolerability investigational compound agent agents evaluate evaluating evaluation
assess assessing assessment determine determining randomized randomised multicenter multicentre
international open-label blinded double-blind participants subjects adults dosing dose doses group
groups versus standard care advanced metastatic locally newly diagnosed recurrent refractory
relapsed malignant malignancy pharmacokinetics pharmacodynamics administration administered
receiving population primary secondary endpoint endpoints outcome outcomes superiority single-arm
""".split()

# Words ignored when a claim is compared with its possible sources.
CLAIM_STOP_WORDS = """
the a an is was are were of in to and or for with by as on at this that it its be has have not no
""".split()

# Common English function words left out of the lexical index.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if
or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now
""".split()

CONTENT_PATTERN = r"[a-z0-9-]+"
CLAIM_PATTERN = r"[a-z0-9]+"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
MIN_CONTENT_LENGTH = 5


def matches(text: Column, pattern: str) -> Column:
    """All matches of `pattern` in lower-cased text; an empty array for null text."""
    return F.coalesce(
        F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>")
    )


def words_outside(words: Column, stop: list[str], min_length: int = 1) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(stop))


def search_tokens(text: Column) -> Column:
    """Every word of the lexical index, with repeats, stop words left out."""
    return words_outside(matches(text, WORD_PATTERN), ENGLISH_STOP_WORDS)


def word_counts(words: Column) -> Column:
    """array<struct(term, tf)>: each distinct word with its count, by the runs of the sorted array."""
    def runs(ordered):
        index = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(
            F.array().cast("array<int>"))
        starts = F.filter(index, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda s, i: F.struct(
            F.get(ordered, s).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(ordered)) - s).alias("tf"))))
    return let(F.array_sort(words), runs)


def content_tokens(text: Column) -> Column:
    """Distinct words long enough and specific enough to serve as grounding evidence."""
    return F.array_distinct(
        words_outside(matches(text, CONTENT_PATTERN), BOILERPLATE_WORDS, MIN_CONTENT_LENGTH)
    )


def claim_tokens(text: Column) -> Column:
    return F.array_distinct(words_outside(matches(text, CLAIM_PATTERN), CLAIM_STOP_WORDS, 3))


def sql_list(words: list[str]) -> str:
    """The words as a quoted SQL list, for statements that must use the same stop list."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
