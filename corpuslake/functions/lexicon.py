"""Fixed values of the text rules: word lists, tables and patterns whose content decides results."""

from __future__ import annotations

BOILERPLATE = ("مزید پڑھیں", "بھی پڑھیں", "تصویر بشکریہ", "ویب ڈیسک", "نمائندہ خصوصی", "خصوصی رپورٹ", "فوٹو فائل", "فائل فوٹو", "رپورٹ:", "ایجنسیاں", "ذریعہ:", "نمائندہ")

#: Replaced characters, their replacements in the same order, and characters that are deleted.
LETTERS_FROM = "آأإٱيك"
LETTERS_TO = "اااایک"
DELETED = "ـ​‌‍‎‏‪‫‬‭‮﻿"

FUSION_ENDINGS = ("گی", "گا", "گے", "ہے", "ہیں", "ہوں", "تھا", "تھی", "تھے", "کریں", "کرے", "کرو", "ہوا", "ہوئی", "ہوئے", "کیا", "کی", "کے", "کا", "آیا", "آئی", "آئے")

VERB_ENDINGS = (
    "جاسکتا ہے", "جاسکتی ہے", "کی جارہی ہے", "کی جارہا ہے", "جارہا ہے", "جارہی ہے", "جاتا ہے", "جاتی ہے", "سکتا ہے", "سکتی ہے", "کیا جاتا ہے",
    "کیا جائے", "کیا گیا", "کی گئی", "کے گئے", "دیا گیا", "دی گئی", "ہو گیا", "ہو گئی", "ہو گئے", "گئی تھی", "گئے تھے", "گیا تھا", "گیا ہے",
    "گئی ہے", "گئے ہیں", "ہوئی ہے", "ہوئے ہیں", "ہوا ہے", "ہیں", "ہوئی", "ہوئے", "ہوا", "گئی", "گئے", "گیا", "تھی", "تھے", "تھا", "گی", "گا", "گے", "ہے",
)

SENTENCE_MARKS = "۔؟!।"
CHUNK_MARKS = ("۔", "؟", "!", "،")

CONFUSABLE = {
    "ب": ("پ",), "پ": ("ب",), "ت": ("ٹ", "ث"), "ٹ": ("ت",), "س": ("ص", "ث"), "ص": ("س",), "ز": ("ذ", "ض", "ظ"), "ذ": ("ز",),
    "ض": ("ظ", "ز"), "ظ": ("ض", "ز"), "ہ": ("ح",), "ح": ("ہ",), "ی": ("ے",), "ے": ("ی",),
}
INSERTED = ("اور", "لیکن", "کہ", "کو", "سے", "میں", "پر", "نے", "تھا", "ہے")
POSTPOSITIONS = {
    "نے": ("کو", "سے", "میں", ""), "کو": ("نے", "سے", "پر", ""), "سے": ("کو", "پر", "میں", ""), "میں": ("پر", "سے", ""),
    "پر": ("میں", "سے", ""), "کا": ("کی", "کے", ""), "کی": ("کا", "کے", ""), "کے": ("کا", "کی", ""),
}
GENDER = {"رہا": "رہی", "رہی": "رہا", "گیا": "گئی", "گئی": "گیا", "کھاتا": "کھاتی", "کھاتی": "کھاتا", "جاتا": "جاتی", "جاتی": "جاتا", "کرتا": "کرتی", "کرتی": "کرتا"}
#: The share of each corruption, in the order in which a uniform number meets them.
CORRUPTION_SHARES = (("spelling", 0.35), ("postposition", 0.30), ("gender", 0.20), ("insertion", 0.10), ("deletion", 0.05))

SNIFFED_LETTERS = "ابپتٹثجچحخدڈذرڑزژسشصضطظعغفقکگلمنہوےیئ"

#: Error types in the order of the generation prompt: type, category, Chinese name, instruction.
ERROR_TYPES = (
    ("spelling_error", "grammar_error", "拼写错误", "Introduce exactly one minor Urdu spelling error by changing, deleting, or inserting one character in one word. Do not change the main meaning."),
    ("postposition_substitution", "grammar_error", "后置词替换错误", "Replace exactly one Urdu postposition or case marker with an incorrect one, such as نے، کو، سے، میں، پر، کا، کی، کے."),
    ("word_insertion", "grammar_error", "词语插入错误", "Insert exactly one unnecessary Urdu word into the sentence, making it unnatural or grammatically wrong."),
    ("postposition_deletion", "grammar_error", "后置词删除错误", "Delete exactly one necessary Urdu postposition or case marker, such as نے، کو، سے، میں، پر، کا، کی، کے."),
    ("word_deletion", "grammar_error", "词语删除错误", "Delete exactly one ordinary Urdu word from the sentence. Do not delete only punctuation."),
    ("gender_agreement", "grammar_error", "性别一致错误", "Introduce exactly one Urdu gender agreement error by changing a masculine/feminine verb, adjective, participle, or possessive form."),
)

SOURCE_KEYS = ("error", "error_sentence", "incorrect", "source", "src", "input")
TARGET_KEYS = ("correct", "correct_sentence", "target", "tgt", "output", "label")
ANSWER_KEYS = ("corrected_sentence", "correct_sentence", "prediction", "answer", "output", "text")
ANSWER_PREFIXES = ("Corrected sentence:", "Corrected:", "Correction:", "Answer:", "Output:", "The corrected sentence is:")

TEXT_NAMES = ("News Text", "news_text", "NewsText", "text", "Text", "body", "Body", "content")
HEADLINE_NAMES = ("Headline", "headline", "title", "Title")
CATEGORY_NAMES = ("Category", "category", "label", "Label", "topic")
SOURCE_NAMES = ("Source", "source", "publisher", "Publisher")

REJECT_REASONS = ("empty_text", "too_short", "too_long", "latin_heavy", "no_urdu_chars", "mojibake", "mostly_symbols", "repetitive", "duplicate")
