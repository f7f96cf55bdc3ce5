"""Text functions as column expressions: whitespace, corpus cleaners, counts, turns, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (null stays null)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def words(text: Column) -> Column:
    """The words between runs of Unicode white space, as an array."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def token_count(text: Column) -> Column:
    """Words and single punctuation marks, as a treebank-style tokenizer counts them."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("long")


def paragraphs(text: Column) -> Column:
    """Lines of a text whose byte-order marks are gone, whose tabs and hard spaces are spaces, runs of which are one,
    with empty and blank lines dropped; a text of nothing else is one empty paragraph."""
    t = F.regexp_replace(text, "\ufeff", "")
    t = F.regexp_replace(t, "[\t ]", " ")
    t = F.regexp_replace(t, " {2,}", " ")
    t = F.regexp_replace(t, "\n(?: ?\n)+", "\n")
    t = F.regexp_replace(t, r"\A\n", "")
    return F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1)


def clean_spaces(text: Column) -> Column:
    """One space for each run of spaces, tabs and hard spaces; none before sentence marks."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t ]+", " "), r" ([.,;!?])", "$1")


def drop_subtitle_lines(text: Column) -> Column:
    """Without the lines, with their newlines, that hold the word in any case."""
    return F.regexp_replace(text, r"(?imd)^.*subtitle.*$\n", "")


def clean_corpus(text: Column, source: Column) -> Column:
    """The cleaner that a corpus' name asks for; other names keep the text."""
    return (
        F.when(source == "simple_wiki", F.replace(text, F.lit("\n\n"), F.lit("")))
        .when(source == "bnc_spoken", F.replace(clean_spaces(text), F.lit("\n\n"), F.lit("")))
        .when(source == "childes", clean_spaces(text))
        .when(source == "open_subtitles", drop_subtitle_lines(text))
        .otherwise(text)
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def squeeze(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(text), " ")


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\b[AB]::", "")


#: Letters that Unicode's full mapping writes as several capitals, with the single capital that some of them have.
_LIGATED = "ß" + "".join(chr(i) for start in (0x1F80, 0x1F90, 0x1FA0) for i in range(start, start + 8)) + "\u1fb3\u1fc3\u1ff3"
_CAPITALS = "ẞ" + "".join(chr(i + 8) for start in (0x1F80, 0x1F90, 0x1FA0) for i in range(start, start + 8)) + "\u1fbc\u1fcc\u1ffc"


def upper_each(text: Column) -> Column:
    """Upper case letter by letter, so that the length stays: ß is ẞ, and a letter without a single capital stays as it is."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    own = lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, _LIGATED, _CAPITALS)).otherwise(F.upper(c))
    return F.array_join(F.transform(letters, own), "")


def alnum_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N} ]", "")


def speaker_initial(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.lit("Unknown")).otherwise(F.left(F.trim(text), F.lit(1)))


def response_content(text: Column, prompt: Column) -> Column:
    """What a model answered: after the last assistant header, else after the last instruction end, else after the
    prompt, else all; end marks and outer white space go."""
    header, inst, eot = "<|start_header_id|>assistant<|end_header_id|>", "[/INST]", "<|eot_id|>"
    part = (
        F.when(F.contains(text, F.lit(header)), F.substring_index(text, header, -1))
        .when(F.contains(text, F.lit(inst)), F.substring_index(text, inst, -1))
        .when(F.startswith(text, prompt), F.substr(text, F.length(prompt) + 1))
        .otherwise(text)
    )
    return F.trim(F.replace(part, F.lit(eot), F.lit("")))


def generated_text(text: Column) -> Column:
    """The part after the first ``Generated Text:`` up to the next one."""
    return F.split_part(text, F.lit("Generated Text:"), F.lit(2))


def chat(system: Column, user: Column) -> Column:
    """A chat prompt as an array of (role, content)."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def turn_prompt(conversation: Column, speaker: Column) -> Column:
    return F.concat(conversation, F.lit("\n"), speaker, F.lit("::"))


#: What a model is told to do: fixed values.
CORRECTION_SYSTEM = (
    "You are a writer capable of continuing partial dialogues or stories that are given to you. "
    "You will be given a partial text (labeled 'Partial Text') and a completion of said text produced by a student of English (labeled 'Student Completion'). "
    "Your goal is to produce a corrected version of the student's completion. This corrected version should be grammatically "
    "correct, coherent and relevant to the initial partial text. If the student's response is gibberish, output your own independent completion."
    "You should only provide your own completion without any added commentary or feedback."
)
CORRECTION_REQUEST = "Now produce your own completion of the Partial Text. Do not include any external commentary."
TEACHER_REQUEST = "Please generate a high-quality completion of the dialogue, taking into account the child's attempt but improving:"


def messages(*parts: tuple[str, Column]) -> Column:
    """A chat as an array of (role, content)."""
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in parts])


def correction_chat(context: Column, completion: Column) -> Column:
    """The chat that asks for a corrected completion of a partial text."""
    return messages(
        ("system", F.lit(CORRECTION_SYSTEM)),
        ("user", F.concat(F.lit("Partial Text: "), context)),
        ("user", F.concat(F.lit("Student Completion: "), completion)),
        ("user", F.lit(CORRECTION_REQUEST)),
        ("assistant", F.concat(F.lit("Partial Text: "), context, F.lit("\n Corrected Completion:"))),
    )


def teacher_prompt(system: Column, dialogue: Column, continuation: Column) -> Column:
    """One string with header marks: the system's text, the dialogue and the child's continuation of it."""
    head = lambda role: F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n")
    end = F.lit("<|eot_id|>")
    asked = [F.lit("Original partial dialogue:\n"), dialogue, F.lit("\n\nChild model's continuation:\n"), continuation, F.lit(f"\n\n{TEACHER_REQUEST}")]
    return F.concat(F.lit("<|begin_of_text|>"), head("system"), system, end, head("user"), *asked, end, head("assistant"))


def first_rounds(text: Column, rounds: int, version: int = 2) -> Column:
    """The first ``rounds`` pairs of marked turns. Version 1 loses turns whose body has a capital A or B, version 2 keeps
    them and joins turns by a space, without a space after the marker."""
    if version == 1:
        turns = F.regexp_extract_all(text, F.lit(r"(?sd)((?:A::|B::)[^AB]*?)(?=(?:A::|B::)|$)"), F.lit(1))
        return F.array_join(F.slice(F.filter(F.transform(turns, strip), lambda t: t != ""), 1, 2 * rounds), "\n")
    turns = F.regexp_extract_all(text, F.lit(r"(?sd)((?:A::|B::).*?)(?=(?:A::|B::)|$)"), F.lit(1))
    return F.array_join(F.transform(F.slice(turns, 1, 2 * rounds), lambda t: F.concat(F.left(t, F.lit(3)), strip(F.substr(t, F.lit(4))))), " ")


def cdi_words(entry: Column) -> Column:
    """The distinct words of a vocabulary entry: parts between slashes without marks around them."""
    return F.array_distinct(F.transform(F.split(entry, "/"), lambda w: F.btrim(w, F.lit("*!? \t"))))
