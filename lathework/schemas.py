"""Schemas of the corpus and of predictions, as DDL."""

from __future__ import annotations

from .dims import QUESTIONS
from .functions.replies import REPLY_FIELDS

METADATA = "image_filename string, source_url string, category string, caption string"
CAPTIONS = "image_path string, caption string, source_url string, status string"
QA_FIELDS = [*REPLY_FIELDS, "adversarial_question", "adversarial_answer"]
QA = "image_path string, caption string, source_url string, " + ", ".join(f"{f} string" for f in QA_FIELDS) + ", status string"
SAMPLED = QA + ", state string, primary_language string"
FINAL = "image_path string, source_url string, " + ", ".join(f"{f} string" for f in QA_FIELDS) + ", language string, `State/UT` string, topic string"
URLS = "language string, url string"
PAGES = "image_path string, text string, page_url string"
OCR_PREDICTIONS = "model string, id string, language string, page_url string, reference_text string, predicted_text string"
_QUESTIONS, _ANSWERS = (", ".join(f"{name}: string" for name in names) for names in (QUESTIONS, QUESTIONS.values()))
VQA_PREDICTIONS = f"model string, id string, language string, `State/UT` string, topic string, source_url string, questions struct<{_QUESTIONS}>, predictions struct<{_ANSWERS}>, references struct<{_ANSWERS}>"
MMT_PREDICTIONS = "model string, id string, target_language string, source_url string, english_caption string, reference_caption string, predicted_caption string"
