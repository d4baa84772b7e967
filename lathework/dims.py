"""Fixed values and the dimension tables made from them.

The tables below are fixed values: results are right only if they are these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words for true and false in each language.
TRUE_FALSE_WORDS = {
    "Bengali": ("ঠিক", "ভুল"),
    "Gujarati": ("સાચું", "ખોટું"),
    "Hindi": ("सही", "गलत"),
    "Kannada": ("ಸರಿ", "ತಪ್ಪು"),
    "Malayalam": ("ശരി", "തെറ്റ്"),
    "Marathi": ("बरोबर", "चूक"),
    "Odia": ("ଠିକ୍", "ଭୁଲ୍"),
    "Punjabi": ("ਸਹੀ", "ਗਲਤ"),
    "Tamil": ("சரி", "தவறு"),
    "Telugu": ("ఒప్పు", "తప్పు"),
    "English": ("True", "False"),
}

# Letters and spellings that stand for the options A to D.
OPTION_LETTERS = {
    "English": {"A": "A", "B": "B", "C": "C", "D": "D"},
    "Hindi": {"ए": "A", "अ": "A", "बी": "B", "ब": "B", "सी": "C", "स": "C", "डी": "D", "द": "D"},
    "Bengali": {"এ": "A", "বি": "B", "সি": "C", "ডি": "D"},
    "Gujarati": {"એ": "A", "બી": "B", "સી": "C", "ડી": "D"},
    "Kannada": {"ಏ": "A", "ಬಿ": "B", "ಸಿ": "C", "ಡಿ": "D"},
    "Malayalam": {"എ": "A", "ബി": "B", "സി": "C", "ഡി": "D"},
    "Marathi": {"ए": "A", "अ": "A", "बी": "B", "ब": "B", "सी": "C", "डी": "D"},
    "Odia": {"ଏ": "A", "ଅ": "A", "ବି": "B", "ସି": "C", "ଡି": "D"},
    "Punjabi": {"ਏ": "A", "ਅ": "A", "ਬੀ": "B", "ਸੀ": "C", "ਡੀ": "D"},
    "Tamil": {"ஏ": "A", "அ": "A", "பி": "B", "சி": "C", "டி": "D"},
    "Telugu": {"ఏ": "A", "ఎ": "A", "బి": "B", "సి": "C", "డి": "D"},
}

# Other words for true and false, and the word that each counts as.
TRUE_FALSE_SYNONYMS = {
    "Malayalam": {"ശരിയാണ്": "ശരി"},
    "Marathi": {"चुकीचे": "चूक"},
    "Odia": {"ଭୁଲ": "ଭୁଲ୍"},
    "Tamil": {"பொய்": "தவறு"},
}

# The primary language of each state; spelled as the folders are.
STATE_LANGUAGE = {
    "Andhra Pradesh": "Telugu",
    "Arunachal Pradesh": "English",
    "Assam": "Assamese",
    "Bihar": "Hindi",
    "Chhattisgarh": "Hindi",
    "Goa": "Konkani",
    "Gujarat": "Gujarati",
    "Haryana": "Hindi",
    "Himachal Pradesh": "Hindi",
    "Jharkhand": "Hindi",
    "Karnataka": "Kannada",
    "Kerala": "Malayalam",
    "Madhya Pradesh": "Hindi",
    "Maharashtra": "Marathi",
    "Manipur": "Meitei",
    "Meghalaya": "English",
    "Mizoram": "Mizo",
    "Nagaland": "English",
    "Odhisa": "Odia",
    "Punjab": "Punjabi",
    "Rajasthan": "Hindi",
    "Sikkim": "Nepali",
    "Tamil Nadu": "Tamil",
    "Telangana": "Telugu",
    "Tripura": "Bengali",
    "Uttar Pradesh": "Hindi",
    "Uttarakhand": "Hindi",
    "West Bengal": "Bengali",
    "Andaman and Nicobar Islands": "Hindi",
    "Chandigarh": "Hindi",
    "Dadra and Nagar Haveli and Daman and Diu": "Gujarati",
    "Delhi": "Hindi",
    "Jammu and Kashmir": "Urdu",
    "Ladakh": "Ladakhi",
    "Lakshadweep": "Malayalam",
    "Puducherry": "Tamil",
}

# Languages that the corpus is translated to.
TARGET_LANGUAGES = ("Hindi", "Gujarati", "Tamil", "Telugu", "Marathi", "Bengali", "Malayalam", "Odia", "Punjabi", "Kannada")

# Codes of the wiki dumps' languages.
DUMP_LANGUAGES = {
    "Hindi": "hi",
    "Bengali": "bn",
    "Tamil": "ta",
    "Telugu": "te",
    "Marathi": "mr",
    "Gujarati": "gu",
    "Malayalam": "ml",
    "Kannada": "kn",
    "Punjabi": "pa",
    "Oriya": "or",
}

# Order and names of the published columns.
PUBLISHED = (
    "image_path", "topic", "State/UT", "language", "short_q1", "short_a1", "short_q2", "short_a2", "mc_q1", "mc_a1", "mc_opt1_1", "mc_opt1_2",
    "mc_opt1_3", "mc_opt1_4", "true_false_q", "true_false_a", "long_q", "long_a", "adversarial_question", "adversarial_answer", "source_url",
)
PUBLISHED_NAMES = {"image_path": "image", "mc_q1": "mcq", "mc_a1": "mcq_a", "mc_opt1_1": "mcq_opt1", "mc_opt1_2": "mcq_opt2", "mc_opt1_3": "mcq_opt3", "mc_opt1_4": "mcq_opt4"}

#: Question types of a sample with the answer that each has.
QUESTIONS = {"short_q1": "short_a1", "short_q2": "short_a2", "mcq": "mcq_a", "true_false_q": "true_false_a", "long_q": "long_a", "adversarial_question": "adversarial_answer"}


def literal_map(values: dict[str, str]) -> Column:
    """A string map as a literal of the plan; folded to a constant."""
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def pair_map(values: dict[str, dict[str, str]]) -> Column:
    """A map of two keys, joined by a control character."""
    return literal_map({f"{a}\x1f{b}": c for a, inner in values.items() for b, c in inner.items()})


def look_up_pair(values: dict[str, dict[str, str]], first: Column, second: Column) -> Column:
    return F.try_element_at(pair_map(values), F.concat_ws("\x1f", first, second))


def states(spark: SparkSession) -> DataFrame:
    """state, primary_language: 36 rows."""
    return spark.createDataFrame(list(STATE_LANGUAGE.items()), "state string, primary_language string")
