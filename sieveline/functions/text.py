"""Column builders for text: cleaning, parsing, counting and predicates. All of them are built-in expressions.

Strings follow Python's rules where they differ from Spark's: white space is Unicode white space, and stripping takes
all of it. Nulls stay null in projections; predicates on null are null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"

# Markers, prefixes and phrases of the record formats.
END = "###END###"
HASHES = "###"
PROMPT_PREFIXES = ("Instruction:", "Q:", "A:", "Response:", "Question:")
NEW_QUESTION_PHRASES = ("next question", "another question", "new question", "now for", "moving on")
RUNAWAY_BASE = ("\n\nInstruction:", "\n\nQuestion:", "\n\nQ:", "\nUser:", "\nAssistant:", "\nHuman:")
RUNAWAY_CHAT = ("<|im_start|>", "<|im_end|>")
RUNAWAY_CHARS = 500
SHORT_ANSWERS = ("Yes", "No", "Yes.", "No.", "True", "False", "True.", "False.")
SHORT_ANSWERS_STRICT = ("Yes", "No", "Yes.", "No.")
BOOLEAN_ANSWERS = ("True", "False", "True.", "False.")
DIRECTIVE_CUES = ("true or false", "is this", "is it", "determine whether", "?")
META_LINES = ("here are", "i will", "let me", "the following", "these are", "below are", "above are")
META_WORDS = ("instruction", "example", "list", "generate", "write", "create")
META_COMPANIONS = ("another", "more")
META_EVAL_WORDS = ("instruction", "example", "list", "generate")


def any_of(conditions: Sequence[Column]) -> Column:
    """OR of conditions, one expression that code generation can fuse; false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def contains_any(x: Column, phrases: Sequence[str]) -> Column:
    return any_of([F.contains(x, F.lit(p)) for p in phrases])


def starts_with_any(x: Column, prefixes: Sequence[str]) -> Column:
    return any_of([F.startswith(x, F.lit(p)) for p in prefixes])


def ends_with_any(x: Column, suffixes: Sequence[str]) -> Column:
    return any_of([F.endswith(x, F.lit(p)) for p in suffixes])


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+\z|^\s+", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"{SPACE}+\z", "")


def norm_key(x: Column) -> Column:
    """The key under which instructions count as equal: stripped and lower-cased."""
    return F.lower(strip(x))


def digest(key: Column) -> Column:
    """128 bits in the place of a long key: what is shuffled and compared. Null stays null."""
    return F.unhex(F.md5(key))


def words(x: Column) -> Column:
    """Pieces between runs of white space, none of them empty."""
    return F.filter(F.split(x, rf"{SPACE}+"), lambda w: w != "")


def n_words(x: Column) -> Column:
    return F.size(words(x))


def chars_div4(x: Column) -> Column:
    """Token count proxy: a quarter of the characters, rounded down."""
    return F.floor(F.length(x) / 4).cast("long")


TOKEN_PROXIES: dict[str, Callable[[Column], Column]] = {"chars": chars_div4, "words": lambda x: n_words(x).cast("long")}


def count_of(x: Column, piece: str) -> Column:
    """Occurrences of a literal piece, not overlapping."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(piece)))) / len(piece)).cast("int")


def head(x: Column, marker: str) -> Column:
    """What stands before the first marker."""
    return F.substring_index(x, marker, 1)


def first_paragraph(x: Column, most: int | None = None) -> Column:
    out = head(x, "\n\n")
    return F.substring(out, 1, most) if most else out


def preview(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


# Cleaning


def clean_response(x: Column) -> Column:
    """The answer itself: up to the end marker, up to a blank line, up to a line that opens another prompt, without
    hash markers, stripped."""
    lines = F.split(first_paragraph(head(x, END)), "\n")

    def opens_prompt(line: Column) -> Column:
        return starts_with_any(line, PROMPT_PREFIXES) | contains_any(F.lower(line), NEW_QUESTION_PHRASES)

    cut = F.array_position(F.transform(lines, opens_prompt), True)
    kept = F.when(cut == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(cut - 1, F.lit(0)).cast("int")))
    joined = F.array_join(kept, "\n")
    return strip(F.replace(F.replace(joined, F.lit(END), F.lit("")), F.lit(HASHES), F.lit("")))


def strip_stop_markers(x: Column) -> Column:
    """Without hashes at the end (any number), and without what follows an end marker."""
    tail = rstrip(F.regexp_replace(x, r"#+\z", ""))
    return F.when(F.contains(tail, F.lit(END)), strip(head(tail, END))).otherwise(tail)


def changed(x: Column) -> Column:
    return ~strip_stop_markers(x).eqNullSafe(x)


# Where a text goes on with another prompt, in order of trust.
CUTOFFS = (r"\n\n(?:Instruction|Q:|A:|Response:)", r"\n(?:What |How |Why |When |Where |Who |Can |Should )")


def layered_cleanup(x: Column, limit: int = 75) -> Column:
    """Cleaning in layers, with what each did: delimiter first, then the first pattern of CUTOFFS that matches."""
    found = F.contains(x, F.lit(END))
    cut = head(x, END)
    places = [F.regexp_instr(cut, F.lit(p)) for p in CUTOFFS]
    at = F.coalesce(*[F.when(p > 0, p) for p in places])
    text = strip(F.when(at.isNotNull(), F.substring(cut, F.lit(1), at - 1)).otherwise(cut))
    return F.struct(text.alias("text"), found.alias("delimiter_found"), (~found).alias("delimiter_missing"), at.isNotNull().alias("heuristic_cutoff"), (n_words(text) >= limit).alias("hit_token_limit"), contains_any(text, (HASHES, *RUNAWAY_CHAT)).alias("forbidden_markers"))


# Phrases of a prompt that its continuation repeats.
PROMPT_ECHOES = ("here are examples", "prompt:", "response:", "another", "would be:")


def first_answer_line(x: Column, echoes: Sequence[str] = PROMPT_ECHOES) -> Column:
    """The first line that repeats nothing of the prompt; the whole stripped text if there is none."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda line: (line != "") & ~contains_any(F.lower(line), echoes))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), strip(x))


def section(x: Column, name: str) -> Column:
    """The lines under a heading `**name**:` or `## name`, up to the next heading."""
    return strip(F.regexp_extract(x, rf"(?s)(?:^|\n)(?:\*\*{name}\*\*:?|##+ {name})[^\n]*\n(.*?)(?=\n(?:\*\*|##)|\z)", 1))


def label_of(x: Column) -> Column:
    """good, bad or unclear, from how an answer starts, else from what it holds."""
    y = F.lower(strip(x))
    chain = F.when(F.startswith(y, F.lit("good")), "good").when(F.startswith(y, F.lit("bad")), "bad")
    return chain.when(F.contains(y, F.lit("good")), "good").when(F.contains(y, F.lit("bad")), "bad").otherwise("unclear")


# Numbered lists


def _numbered(line: Column) -> Column:
    """What follows the number of a list line, or null: the number ends at the first full stop, without one at the
    first bracket."""
    dot, bracket = F.instr(line, "."), F.instr(line, ")")
    at = F.when(dot > 0, dot).when(bracket > 0, bracket)
    number = strip(F.substring(line, F.lit(1), at - 1))
    text = strip(F.substring(line, at + 1, F.length(line)))
    return F.when(number.rlike(r"(?U)^\d+\z") & (text != ""), text)


def parse_numbered(x: Column, most: int = 50) -> Column:
    """Texts of a numbered list, without comments on the list; at most so many."""
    texts = F.array_compact(F.transform(F.split(x, "\n"), lambda line: _numbered(strip(line))))
    return F.slice(F.filter(texts, lambda t: ~contains_any(F.lower(t), META_LINES)), 1, most)


def parse_numbered_regex(x: Column) -> Column:
    """The strict form: digits, a full stop or bracket, and text that is a valid instruction."""
    texts = F.transform(F.split(x, "\n"), lambda line: F.regexp_extract(strip(line), r"(?U)^\d+[.)]\s*(.+)\z", 1))
    return F.filter(F.transform(texts, strip), lambda t: (t != "") & valid_instruction(t))


def _after_number(line: Column) -> Column:
    dot, bracket = F.instr(line, "."), F.instr(line, ")")
    at = F.when(dot > 0, dot).when(bracket > 0, bracket)
    return F.when(line.rlike(r"(?U)^\d"), strip(F.substring(line, at + 1, F.length(line))))


def parse_numbered_diverse(x: Column, most: int) -> Column:
    """Lines that start with a digit, of ten characters or more, unless they ask for more of the list."""
    texts = F.array_compact(F.transform(F.split(strip(x), "\n"), lambda line: _after_number(strip(line))))
    meta = lambda t: contains_any(F.lower(t), META_WORDS) & contains_any(F.lower(t), META_COMPANIONS)
    return F.slice(F.filter(texts, lambda t: (F.length(t) >= 10) & ~meta(t)), 1, most)


def parse_numbered_eval(x: Column, lines: int = 3) -> Column:
    """From the first non-empty lines only; no texts that talk about instructions."""
    some = F.slice(F.filter(F.transform(F.split(x, "\n"), strip), lambda line: line != ""), 1, lines)
    texts = F.array_compact(F.transform(some, _after_number))
    return F.filter(texts, lambda t: (F.length(t) >= 10) & ~contains_any(F.lower(t), META_EVAL_WORDS))


# Predicates


def is_runaway(x: Column, patterns: Sequence[str] = (*RUNAWAY_BASE, *RUNAWAY_CHAT), most: int = RUNAWAY_CHARS) -> Column:
    """Goes on into another prompt, or is longer than an answer."""
    return contains_any(x, patterns) | (F.length(x) > most)


def is_truncated(x: Column, short_answers: Sequence[str] = SHORT_ANSWERS) -> Column:
    y = strip(x)
    return F.endswith(y, F.lit(":")) | _stops_at_dash(y) | ((F.length(y) < 10) & ~y.isin(*short_answers))


def _stops_at_dash(y: Column) -> Column:
    """Whether a stripped text ends with a digit, bracket or full stop, words behind it and a dash: `5) Biomass Energy -`.
    Read from the end, where each character is met at most twice; a group that repeats for each word would take the stack
    of the task, and a search from the start would go over a long run of numbers once for each of them."""
    return F.endswith(y, F.lit("-")) & F.reverse(y).rlike(r"(?U)\A-[\w\s]*\w\s+[\d).]")


def is_true_false(instruction: Column, response: Column) -> Column:
    """A bare statement that was judged true or false."""
    return strip(response).isin(*BOOLEAN_ANSWERS) & ~contains_any(F.lower(instruction), DIRECTIVE_CUES)


def route(instruction: Column, response: Column, truncated_first: bool = True, short_answers: Sequence[str] = SHORT_ANSWERS) -> Column:
    """truncated, true_false or kept; the order decides on rows that are both."""
    tests = [(is_truncated(response, short_answers), "truncated"), (is_true_false(instruction, response), "true_false")]
    (a, x), (b, y) = tests if truncated_first else tests[::-1]
    return F.when(a, x).when(b, y).otherwise("kept")


def leaks_delimiter(x: Column, marker: str = HASHES) -> Column:
    return F.contains(x, F.lit(marker))


# Signs of talk about a list instead of an entry of it, and openings of no instruction.
META_INDICATORS = ("instruction", "example", "following", "team", "created", "testing", "...", "[", "]")
NO_INSTRUCTION = ("the", "this", "these", "those", "an example")


def valid_instruction(x: Column, least: int = 10, most: int = 200) -> Column:
    y = F.lower(strip(x))
    meta = contains_any(y, META_INDICATORS) & ~F.contains(y, F.lit("follow"))
    return F.length(strip(x)).between(least, most) & ~meta & ~starts_with_any(y, NO_INSTRUCTION)


# Signs of a chat template, and openings of an assistant's talk.
CHAT_MARKERS = ("<|im_start|>", "<|im_end|>", "system", "user", "assistant", "You are a helpful", "I am an AI", "As an AI")
ASSISTANT_OPENINGS = ("I ", "As an", "Here is", "Sure,", "Of course")


def contamination(x: Column) -> Column:
    """Which chat markers a text holds, whether it opens like an assistant, and whether it ends as a sentence."""
    hits = F.array_compact(F.array(*[F.when(F.contains(x, F.lit(m)), F.lit(m)) for m in CHAT_MARKERS]))
    return F.struct(hits.alias("markers"), starts_with_any(strip(x), ASSISTANT_OPENINGS).alias("assistant_like"), (strip(x).rlike(r"[.!?]\z") & (F.length(strip(x)) > 10)).alias("clean_end"))


def numbered_lines(x: Column) -> Column:
    return F.size(F.filter(F.split(x, "\n"), lambda line: strip(line).rlike(r"(?U)^\d")))


def has_json(x: Column) -> Column:
    """Whether what stands from the first brace to the last is JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))).isNotNull()


def direct_math(x: Column, answer: str = "4", others: Sequence[str] = ("3", "5", "6")) -> Column:
    return F.contains(x, F.lit(answer)) & ~contains_any(x, others)


SEASONS = ("spring", "summer", "autumn", "fall", "winter")


def n_named(x: Column, names: Sequence[str]) -> Column:
    """How many of the names a text holds."""
    return reduce(lambda a, b: a + b, [F.contains(F.lower(x), F.lit(n)).cast("int") for n in names], F.lit(0))


def structure(x: Column) -> Column:
    return F.struct((numbered_lines(x) >= 2).alias("numbered_list"), has_json(x).alias("json"), (n_named(x, SEASONS) >= 2).alias("seasons"), direct_math(x).alias("direct_math"))


# Stock phrases of responses that no model wrote.
STOCK_PHRASES = ("essential nutrients", "fundamental force", "careful consideration", "interconnected concepts", "comprehensive insights")


def is_placeholder(x: Column) -> Column:
    return contains_any(x, STOCK_PHRASES)


def sentinel_passed(response: Column, expected: Column) -> Column:
    """Whether a probe came out as expected: a model that should fail gives nothing structured; one that should pass
    gives a short answer."""
    y = strip(response)
    structured = starts_with_any(y, ("1.", "-")) | F.contains(F.substring(response, 1, 50), F.lit("\n\n")) | F.contains(F.substring(response, 1, 20), F.lit(":"))
    return F.when(expected == "fail", ~structured).otherwise((F.length(y) > 0) & (F.length(y) < 100))


def template_free(plain_ids: Column, special_ids: Column, chat_ids: Sequence[int]) -> Column:
    """Tokens are as many with special tokens as without, and none is one of a chat template."""
    return (F.size(plain_ids) == F.size(special_ids)) & ~F.arrays_overlap(special_ids, F.array(*[F.lit(i) for i in chat_ids]))


# Formats


def sft_text(instruction: Column, response: Column) -> Column:
    return F.concat(F.lit("Instruction: "), instruction, F.lit("\nResponse: "), response, F.lit(END))


DPO_PROMPTS = {"response": "Instruction: {}\nResponse:", "bare": "Instruction: {}", "spaced": "Instruction: {}\nResponse: ", "stored": "{}"}


def dpo_prompt(instruction: Column, variant: str = "response") -> Column:
    before, after = DPO_PROMPTS[variant].split("{}")
    return F.concat(F.lit(before), instruction, F.lit(after))


def loss_mask(ids: Column, prompt: Column, ignore: int = -100) -> Column:
    """Labels for training: the first prompt tokens are ignored. prompt stands in no lambda, which would work it out anew for
    each token."""
    masked = F.least(F.greatest(prompt, F.lit(0)), F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(ignore), masked), F.slice(ids, masked + 1, F.size(ids)))


def padded(ids: Column, size: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0))))


def few_shot_prompt(examples: Column, instruction: Column, before_end: str = "\n") -> Column:
    """Examples (array of structs instruction, response), each with its end mark, then the instruction to answer.
    before_end: what stands between a response and the mark; completion prompts have nothing there."""
    shots = F.transform(examples, lambda e: F.concat(F.lit("Instruction: "), e["instruction"], F.lit("\nResponse: "), e["response"], F.lit(before_end + END + "\n")))
    return F.concat(F.array_join(shots, "\n"), F.lit("\n"), dpo_prompt(instruction))


def critic_prompt(instruction: Column, response: Column, most: int = 500) -> Column:
    return F.concat(F.lit("Instruction: "), instruction, F.lit("\nResponse: "), first_paragraph(response, most), F.lit("\n\nIs this response A (good) or B (bad)?\nAnswer:"))


def improvement_prompt(instruction: Column, response: Column, critique: Column) -> Column:
    """What a model completes with a better response."""
    return F.concat(F.lit("Instruction: "), instruction, F.lit("\nDraft: "), first_paragraph(response), F.lit("\nCritique: "), critique, F.lit("\nBetter response:"))


def principle_prompt(instruction: Column, response: Column, principle: Column) -> Column:
    """What a model completes with a critique of a response in the light of a principle."""
    return F.concat(F.lit("Principle: "), principle, F.lit("\nInstruction: "), instruction, F.lit("\nResponse: "), first_paragraph(response), F.lit("\nCritique:"))


# Critic verdicts


def critique(logp_a: Sequence[Column], logp_b: Sequence[Column], threshold: float = 1.0) -> Column:
    """The verdict from log-probabilities of the two labels, each the best of its spellings. A tie is bad."""
    best = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
    a, b = best(logp_a), best(logp_b)
    margin = F.abs(a - b)
    return F.struct((a > b).alias("is_good"), F.when(a > b, "A").otherwise("B").alias("predicted_label"), a.alias("logp_a"), b.alias("logp_b"), margin.alias("margin"), (margin >= threshold).alias("confident"), F.lit(threshold).alias("confidence_threshold"))


def accepted(verdict: Column) -> Column:
    return verdict["is_good"] & verdict["confident"]


def inferred_critique(instruction_critique: Column, pair_critique: Column, note: str = "Inferred from pair critique") -> Column:
    """The instruction's critique; where it is missing, the pair's, marked as such."""
    fields = ("is_good", "predicted_label", "logp_a", "logp_b", "margin", "confident")
    own = F.struct(*[instruction_critique[f].alias(f) for f in fields], F.lit(False).alias("_inferred"), F.lit(None).cast("string").alias("_note"))
    pair = F.struct(*[pair_critique[f].alias(f) for f in fields], F.lit(True).alias("_inferred"), F.lit(note).alias("_note"))
    return F.when(instruction_critique.isNotNull(), own).when(pair_critique.isNotNull(), pair)


def relaxed_sentinels(results: Column, name: str) -> Column:
    """Probes (array of structs name, response, passed) with the named one judged by length alone."""
    fixed = lambda s: (F.length(strip(s["response"])) > 0) & (F.length(strip(s["response"])) < 100)
    return F.transform(results, lambda s: F.when(s["name"] == name, s.withField("passed", fixed(s))).otherwise(s))


def all_passed(results: Column) -> Column:
    return F.forall(results, lambda s: s["passed"])
