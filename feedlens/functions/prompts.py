"""Prompt and model-input texts as column expressions (``concat`` of literals and fields).

Each builder has a DuckDB twin (``sql_*``) producing the same text, used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.text import clean_field, py_str, sql_clean_field, sql_py_str, sql_strip, strip

# ---------------------------------------------------------------------------------------------
# Prompt wording that must equal the source's for equal prompts and replies.
GEN_INSTRUCTION = (
    "Given a math question, the correct answer, and an incorrect answer chosen by a student, "
    "write feedback for the incorrect answer that would help the student understand and correct their mistake. "
    "The feedback should be short, only one or two sentences."
)
GEN_RUBRIC = (
    "Additionally, keep the following requirements in mind:\n"
    "1. The feedback should not make any incorrect statements.\n"
    "2. The feedback should not directly reveal the answer to the question.\n"
    "3. The feedback should give suggestions to the student on how to improve their answer.\n"
    "4. The feedback should point out the misconception underlying the student's answer.\n"
    "5. The feedback should have a positive and encouraging tone."
)
EXPERT_SYSTEM = "You are a math education expert."
DEFAULT_SYSTEM = "You are a helpful assistant."
BINARY_GRADING_HEAD = (
    "Your job is to evaluate feedback given to students on math problems.\n\n"
    "Here is the question, the correct solution, the incorrect answer the student gave, and the feedback given to the student:\n"
)
BINARY_GRADING_QUESTIONS = (
    "For the following questions, provide a short explanation and then answer with \"Yes\" or \"No\":\n"
    "1. Does the feedback make any incorrect statements?\n"
    "2. Does the feedback directly reveal the answer to the question?\n"
    "3. Does the feedback give suggestions to the student on how to improve the answer?\n"
    "4. Does the feedback correctly point out the misconception underlying the student's answer?\n"
    "5. Does the feedback have a positive or encouraging tone?"
)
LIKERT_GRADING_HEAD = (
    "Your job is to evaluate feedback given to students on math problems.\n\n"
    "You will be given a question, the correct solution, the incorrect answer a student gave, "
    "and the feedback given to the student. Please evaluate the feedback for each of the following "
    "categories using a likert scale. For each category, first think step-by-step and then provide "
    "the final score using \"Score: <value>\".\n\n"
    "Accuracy: "
    "2 - the feedback only makes correct and accurate statements and correctly pertains to the question and student's answer. "
    "1 - the feedback makes inaccurate statements or does not pertain to the question or the answer that the student gave.\n"
    "Revealing: "
    "2 - the feedback does not directly mention the answer to the question (indirectly hinting at the answer is okay). "
    "1 - the feedback directly and clearly mentions the answer to the question.\n"
    "Suggestions: "
    "3 - the feedback gives a suggestion to the student that, when followed, will lead them to the correct answer. "
    "2 - the feedback does not explicitly provide a suggestion, but implicitly hints at something the student can do to reach the correct answer. "
    "1 - the feedback does not provide any suggestions OR the feedback provides a suggestion that will not help the student reach the correct answer OR the feedback provides a suggestion that does not pertain to the current question or student answer.\n"
    "Misconception: "
    "3 - the feedback correctly points out the error the student made. "
    "2 - the feedback does not explicitly point out the underlying misconception, but implicitly hints at the error the student made or partially identifies the misconception. "
    "1 - the feedback does not address the student's error OR identifies a misconception that does not reflect the actual error the student made.\n"
    "Positive: "
    "3 - the feedback has a positive or encouraging tone (even mildly positive counts). "
    "2 - the feedback is neutral in tone. "
    "1 - the feedback is blunt, impersonal, or not positive.\n\n"
    "Here is the question, the student's answer, and the feedback to evaluate::\n"
)
RM_HEAD = ("Given a question, its solution, the incorrect answer a student gave, and the feedback given to the "
           "student, evaluate the feedback.\n")
# ---------------------------------------------------------------------------------------------


def instruction(include_rubric: bool = False) -> str:
    return GEN_INSTRUCTION + ("\n\n" + GEN_RUBRIC if include_rubric else "")


def _txt(parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _sql_txt(parts) -> str:
    return "concat(" + ", ".join(p[1:] if p.startswith("\x00") else sql_lit(p) for p in parts) + ")"


def sql_lit(s: str) -> str:
    """A SQL string literal; newlines become ``chr(10)``."""
    pieces = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in pieces) if len(pieces) > 1 else f"'{pieces[0]}'"


def _e(expr: str) -> str:
    """Mark a SQL expression (as opposed to a literal) inside a parts list."""
    return "\x00" + expr


# ---- generation prompts -----------------------------------------------------------------

def prompt_input(with_solution: bool = False, prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    if with_solution:
        return _txt(["Problem: ", strip(py_str(c("question"))), "\nCorrect Answer: ", strip(py_str(c("correct_answer"))),
                     "\nSolution: ", strip(py_str(c("explanation"))), "\nIncorrect Answer: ", strip(py_str(c("distractor")))])
    return _txt(["Question: ", strip(py_str(c("question"))), "\nCorrect Answer: ", strip(py_str(c("correct_answer"))),
                 "\nIncorrect Answer: ", strip(py_str(c("distractor")))])


def sql_prompt_input(with_solution: bool = False, prefix: str = "") -> str:
    s = lambda n: _e(sql_strip(sql_py_str(prefix + n)))
    if with_solution:
        parts = ["Problem: ", s("question"), "\nCorrect Answer: ", s("correct_answer"), "\nSolution: ",
                 s("explanation"), "\nIncorrect Answer: ", s("distractor")]
    else:
        parts = ["Question: ", s("question"), "\nCorrect Answer: ", s("correct_answer"), "\nIncorrect Answer: ",
                 s("distractor")]
    return _sql_txt(parts)


def prompt_output(prefix: str = "") -> Column:
    return _txt(["Feedback: ", strip(py_str(F.col(prefix + "feedback")))])


def sql_prompt_output(prefix: str = "") -> str:
    return _sql_txt(["Feedback: ", _e(sql_strip(sql_py_str(prefix + "feedback")))])


def zero_shot(input_col: Column, include_rubric: bool = False) -> Column:
    return _txt([instruction(include_rubric) + "\n\n", input_col, "\nFeedback:"])


def sql_zero_shot(input_sql: str, include_rubric: bool = False) -> str:
    return _sql_txt([instruction(include_rubric) + "\n\n", _e(input_sql), "\nFeedback:"])


# ---- grading prompts ----------------------------------------------------------------------

_GRADE_FIELDS = (("Question: ", "question"), ("\nCorrect Answer: ", "correct_answer"),
                 ("\nSolution: ", "explanation"))


def annotation_prompt(likert: bool = False) -> Column:
    if likert:
        parts = [LIKERT_GRADING_HEAD]
        fields = _GRADE_FIELDS + (("\nStudent Answer: ", "distractor"), ("\nFeedback: ", "feedback"))
    else:
        parts = [BINARY_GRADING_HEAD]
        fields = _GRADE_FIELDS + (("\nIncorrect Answer: ", "distractor"), ("\nFeedback: ", "feedback"))
    for label, col in fields:
        parts += [label, py_str(col)]
    if not likert:
        parts.append("\n\n" + BINARY_GRADING_QUESTIONS)
    return _txt(parts)


def sql_annotation_prompt(likert: bool = False) -> str:
    if likert:
        parts = [LIKERT_GRADING_HEAD]
        fields = _GRADE_FIELDS + (("\nStudent Answer: ", "distractor"), ("\nFeedback: ", "feedback"))
    else:
        parts = [BINARY_GRADING_HEAD]
        fields = _GRADE_FIELDS + (("\nIncorrect Answer: ", "distractor"), ("\nFeedback: ", "feedback"))
    for label, col in fields:
        parts += [label, _e(sql_py_str(col))]
    if not likert:
        parts.append("\n\n" + BINARY_GRADING_QUESTIONS)
    return _sql_txt(parts)


# ---- fine-tuning prompt ------------------------------------------------------------------

def sft_prompt(include_rubric: bool = False) -> Column:
    head = EXPERT_SYSTEM + "\n" + GEN_INSTRUCTION + "\n" + (GEN_RUBRIC + "\n" if include_rubric else "")
    return _txt([head + "\nQuestion: ", clean_field("question"), "\nCorrect Answer: ", clean_field("correct_answer"),
                 "\nSolution: ", clean_field("explanation"), "\nStudent's Incorrect Answer: ", clean_field("distractor"),
                 "\nFeedback:"])


def sql_sft_prompt(include_rubric: bool = False) -> str:
    head = EXPERT_SYSTEM + "\n" + GEN_INSTRUCTION + "\n" + (GEN_RUBRIC + "\n" if include_rubric else "")
    return _sql_txt([head + "\nQuestion: ", _e(sql_clean_field("question")), "\nCorrect Answer: ",
                     _e(sql_clean_field("correct_answer")), "\nSolution: ", _e(sql_clean_field("explanation")),
                     "\nStudent's Incorrect Answer: ", _e(sql_clean_field("distractor")), "\nFeedback:"])


def completion(col: str = "feedback") -> Column:
    return strip(py_str(col))


# ---- reward-model inputs -------------------------------------------------------------------

def rm_input(feedback: Column | None = None, encoder_only: bool = False) -> Column:
    parts = [RM_HEAD + "Question: ", strip(py_str("question")), "\nSolution: ", strip(py_str("explanation")),
             "\nIncorrect Answer: ", strip(py_str("distractor"))]
    if not encoder_only:
        fb = py_str("feedback") if feedback is None else py_str(feedback)
        parts += ["\nFeedback: ", strip(fb)]
    return _txt(parts)


def sql_rm_input(encoder_only: bool = False) -> str:
    parts = [RM_HEAD + "Question: ", _e(sql_strip(sql_py_str("question"))), "\nSolution: ",
             _e(sql_strip(sql_py_str("explanation"))), "\nIncorrect Answer: ", _e(sql_strip(sql_py_str("distractor")))]
    if not encoder_only:
        parts += ["\nFeedback: ", _e(sql_strip(sql_py_str("feedback")))]
    return _sql_txt(parts)


def rm_decoder_input(feedback: Column | None = None) -> Column:
    fb = py_str("feedback") if feedback is None else py_str(feedback)
    return _txt(["Feedback: ", strip(fb)])


# ---- chat messages -------------------------------------------------------------------------

def chat_messages(prompt: Column, history: Column | None = None, system: Column | None = None) -> Column:
    """``[system] + history + [user]`` as an array of (role, content) structs."""
    sys_msg = F.struct(F.lit("system").alias("role"), F.coalesce(system, F.lit(DEFAULT_SYSTEM))
                       .alias("content")) if system is not None else F.struct(
        F.lit("system").alias("role"), F.lit(DEFAULT_SYSTEM).alias("content"))
    user = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    hist = history if history is not None else F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.array(sys_msg), F.coalesce(hist, F.array().cast("array<struct<role:string,content:string>>")),
                    F.array(user))
