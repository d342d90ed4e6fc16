"""Word lists and lookup tables that results depend on. All are fixed values; every operator takes others as a parameter."""

from __future__ import annotations

EFFECT_DIRECTIONS = ("increased", "decreased", "no_significant_effect", "associated", "changed", "mixed", "unclear")
HEALTH_INTERPRETATIONS = ("beneficial", "harmful", "neutral", "mixed", "unclear")
EFFECT_SYNONYMS = {
    "increased": ("increase", "increases", "increased", "higher", "elevated", "enhanced", "enhancement"),
    "decreased": ("decrease", "decreases", "decreased", "reduced", "reduction", "lower", "lowered"),
    "changed": ("improved", "improvement", "impaired", "altered", "changed", "modulated"),
    "no_significant_effect": ("no_effect", "no_significant_effect", "no_significant_difference", "not_significant", "neutral"),
    "associated": ("associated", "association", "linked", "preferred"),
    "mixed": ("mixed",),
    "unclear": ("unclear", "unknown", ""),
}
HEALTH_SYNONYMS = {
    "beneficial": ("benefit", "beneficial", "positive", "favorable", "protective"),
    "harmful": ("harm", "harmful", "negative", "adverse", "deleterious"),
    "neutral": ("neutral", "no_effect", "no_significant_effect"),
    "mixed": ("mixed",),
    "unclear": ("unclear", "unknown", ""),
}
DIRECTION_SYNONYMS = {
    "positive": ("positive", "beneficial", "favorable", "improved"),
    "negative": ("negative", "harmful", "adverse", "deleterious"),
    "neutral": ("neutral", "no_effect", "no_significant_effect", "no_significant_difference"),
}
ADVERSE_OUTCOMES = (
    "adverse", "body_mass_index", "chemotherapy_induced_diarrhea", "cholesterol", "constipation", "crp", "c_terminal_telopeptide", "depression", "diabetes", "diarrhea", "erythema",
    "fasting_serum_glucose", "glucose", "hba1c", "hs_crp", "homa", "inflammation", "insulin_resistance", "itching", "lesion", "nausea", "nec", "osteoporosis", "p_value",
    "parathyroid_hormone", "risk", "severity", "symptom", "triacylglycerol", "triglyceride", "vomiting", "waist_circumference", "white_spot",
)
BENEFICIAL_OUTCOMES = ("antioxidant", "bifidobacteria", "bmd", "bone_mineral_density", "glutathione", "hdl", "lumbar_spine", "microbiota_diversity")
OUT_OF_SCOPE_SUBJECTS = (
    "caffeine", "cell_free", "cell_free_supernatant", "traditional_chinese_herbal", "chinese_herbal", "herbal_decoction", "herbal_therapy", "neutralized_cell_free_supernatant",
    "neutralized_supernatant", "tcht",
)
IN_SCOPE_SUBJECTS = (
    "actimel", "amazake", "bifidobacter", "cheese", "dahi", "dairy", "doogh", "ecologic", "ecologic_barrier", "ecologic_panda", "ecologicbarrier", "epi_7", "ferment_filtrate", "fermented",
    "fermented_milk_preparation", "fermented_soy", "fermented_soybean", "fortified_tempeh", "fortified_yogurt", "gaio", "human_milk_oligosaccharide", "ibp_9414", "fucosyllactose", "kefir",
    "kimchi", "kombucha", "lacto_n_neotetraose", "lab_diet", "lactic_acid_bacteria", "lactobac", "lactococcus", "lactiplantibacillus", "laal_dahi", "live_biotherapeutic",
    "malted_rice_amazake", "milk", "miso", "natto", "prebiotic", "probiotic", "postbiotic", "psychobiotic", "probio_eco", "saccharomyces", "sauerkraut", "starter_culture", "synbiotic",
    "tempeh", "vsl", "vsl3", "winclove", "weissella", "yeast", "zymomonas", "yogurt", "yoghurt",
)
OUT_OF_SCOPE_OUTCOMES = (
    "acid_resilience", "acidic_resilience", "acid_resistance", "acid_tolerance", "acidic_challenge", "acidification_capacity", "acidification", "aggregation_and_adhesion",
    "aggregation_profile", "antimicrobial_activity_against", "antimicrobial_activity_zone", "antimicrobial_mechanism", "adhesion_profile", "acidic_stress_tolerance",
    "exopolysaccharide_production", "filamentous_fungi", "food_matrix", "gastrointestinal_tolerance", "innocua", "listeria_innocua", "osmotic_stress", "osmotic_tolerance",
    "osmotic_challenge", "pathogen_inhibition", "antagonistic_effect", "anti_staphylococcus", "antifungal_activity", "pseudomonas_aeruginosa", "aeruginosa", "quinoa_matrix",
    "riboflavin_production", "staphylococcus_inhibition", "starter_culture", "zone_of_inhibition",
)
STRAIN_PREFIXES = ("bifidobacterium_", "lactobacillus_", "lactococcus_", "lactiplantibacillus_", "saccharomyces_", "weissella_")
COMPOUND_MARKERS = ("+", "combination", "formulation", "supplement", "yogurt")
INTERVENTION_TYPES = ("intervention", "supplement", "treatment", "product", "formulation")
NON_RESULT_PHRASES = (
    "aimed to", "aims to", "designed to", "objective", "objectives", "the aim of", "the purpose of", "we investigated", "we examine", "examining the effects", "determine the effects",
    "was conducted to", "were randomly assigned", "participants were recruited", "this study investigated", "this trial",
)
REVIEW_MARKERS = ("meta-analysis", "systematic review", "network meta-analysis", "umbrella review", "scoping review")
PRIMARY_MARKERS = ("randomized", "randomised", "clinical trial", "double-blind", "placebo-controlled", "crossover")
RESULT_MARKERS = (
    "95% ci", "achieved", "associated with", "compared with", "compared to", "decreased", "did not", "existed", "found on", "greatest reduction", "improved", "increase", "increased", "lower",
    "lowered", "md", "no increase", "no significant", "observed", "odds ratio", "p ", "p\u2009", "p<", "p =", "reduced", "reduction", "risk ratio", "rr:", "significant", "smd",
)
OUTCOME_ALIASES = {
    "fasting_plasma_glucose": ("fasting plasma glucose", "fpg"),
    "hba1c": ("hba1c", "hemoglobin a1c"),
    "total_cholesterol": ("total cholesterol",),
    "lumbar_spine_bone_mineral_density": ("lumbar spine bone mineral density", "lumbar spine bmd"),
    "parathyroid_hormone": ("parathyroid hormone",),
    "adverse_events": ("adverse event", "adverse reaction"),
    "total_hip_bone_mineral_density": ("total hip bmd", "total hip bone mineral density"),
    "osteocalcin": ("osteocalcin",),
    "c_terminal_telopeptide": ("c-terminal telopeptide",),
    "alkaline_phosphatase": ("alkaline phosphatase",),
    "osteoprotegerin": ("osteoprotegerin",),
    "depression_symptoms": ("beck depression inventory", "depression"),
    "serum_insulin": ("serum insulin", "insulin levels"),
    "insulin_resistance": ("insulin resistance", "homa-ir", "homeostasis model assessment of insulin resistance"),
    "hs_crp": ("hs-crp", "c-reactive protein"),
    "glutathione": ("glutathione",),
    "diarrhea": ("diarrhea",),
    "constipation": ("constipation",),
    "nausea": ("nausea",),
    "vomiting": ("vomiting",),
}
#: Sample sizes in full texts, the first that applies.
FULL_TEXT_SAMPLE_PATTERNS = (
    r"a\s+total\s+of\s+(\d+)\s*(?:participants?|subjects?|patients?|women|men|individuals?)",
    r"(\d+)\s*(?:participants?|subjects?|patients?|women|men|individuals?)\s*(?:were\s+)?(?:enrolled|recruited|included|randomized)",
    r"(?:total\s+)?n\s*[=:]\s*(\d+)",
    r"(\d+)\s*(?:healthy\s+)?(?:volunteers?|subjects?|participants?|patients?)",
)
ALIAS_RULES = {"yogurt": "yoghurt", "kefir": "kephir", "kimchi": "kimchee", "kombucha": "combucha"}
DIRECTION_PHRASES = {"positive": "a positive reported effect or association", "negative": "a negative reported effect or association", "neutral": "no statistically significant or neutral reported effect"}
DECREASE_MARKERS = ("decrease", "decreased", "decreases", "reduced", "reduction", "lower", "lowered", "md\u2009=\u2009-", "md = -", "smd: -")
INCREASE_MARKERS = ("increased", "improved", "rise", "smd: 0.", "smd: 1.", "smd 0.", "smd 1.")
NO_EFFECT_MARKERS = ("no significant", "no increase", "did not")
#: Phrase to subject, the first that applies.
RETRY_SUBJECTS = (
    ("lactocare", "LactoCare synbiotic"),
    ("probiotic/synbiotic", "probiotic synbiotic supplement"),
    ("probiotic supplements", "probiotic supplement"),
    ("probiotic supplementation", "probiotic supplement"),
    ("combination of bifidobacterium", "multi strain probiotic formulation"),
    ("multi-strain", "multi strain probiotic formulation"),
    ("yogurt containing", "probiotic yogurt"),
    ("yeast containing saccharomyces cerevisiae", "saccharomyces cerevisiae yeast"),
    ("probiotic", "probiotic supplement"),
    ("synbiotic", "synbiotic supplement"),
)
GENERA = ("Lactobacillus", "Bifidobacterium", "Streptococcus", "Lactococcus", "Leuconostoc", "Pediococcus", "Enterococcus", "Bacillus", "Saccharomyces")
STRAIN_BLACKLIST = (
    "not reported", "not specified", "na", "n/a", "unknown", "unspecified", "phage therapy", "bacteriophage therapy", "probiotic", "probiotics", "beneficial microbes", "beneficial bacteria",
    "commensal bacteria", "gut microbiota", "gut microbiome", "intestinal microbiota", "fermented food", "fermented foods", "fermented product", "fortified yogurt", "fortified milk",
    "fortified drink", "mixed probiotics", "probiotic mixture", "probiotic blend", "commercial probiotic", "probiotic supplement", "probiotic product", "yogurt drink", "yogurt beverage",
    "fermented dairy", "kefir grains", "scoby", "kombucha culture",
)
STRAIN_PATTERNS = (
    r"^[A-Z][a-z]+\s+[a-z]+\s+[\w\-]+$",
    r"^[A-Z]\.\s*[a-z]+\s+[\w\-]+$",
    r"^[A-Z][a-z]+\s+[a-z]+\s+subsp\.\s+[a-z]+\s+[\w\-]+$",
    r"^[A-Z]\.\s*[a-z]+\s+subsp\.\s+[a-z]+\s+[\w\-]+$",
    r"^[A-Z][a-z]+\s+[a-z]+\s+subsp\.\s+[a-z]+\s+[A-Z]+[\s\-]*\d+$",
)
#: Food synonyms, applied in this order to a name or its beginning.
FOOD_SYNONYMS = (
    ("yoghurt", "yogurt"), ("yoghurts", "yogurt"), ("yogurts", "yogurt"), ("probiotic yogurt", "probiotic_yogurt"), ("fermented dairy", "fermented_dairy"), ("dairy products", "dairy"),
    ("milk product", "dairy"), ("kephir", "kefir"), ("kafir", "kefir"),
)
INVALID_FOODS = ("placebo", "intervention", "comparison", "control", "baseline", "biological_factor", "biological factor", "male", "female", "male sex", "female sex")
INVALID_FOOD_PATTERNS = (
    r"^male(?:_| )", r"^female(?:_| )", r"^control(?:_| )", r"^placebo(?:_| )?", r"^comparison$", r"^intervention$", r"^conditioning_", r"^week\d*$", r"^day[_\s-]?\d+", r"^month\d*$",
    r"^follow[_\s-]?up",
)
SUSPICIOUS_FOOD_PATTERNS = (r"^male(?:_| )", r"^female(?:_| )", r"^placebo$", r"^control(?:_| )", r"^comparison$", r"^intervention$", r"^conditioning_")
ACTION_PRIORITY = {"merge": 0, "rename": 1, "normalize": 2, "retype": 3, "delete_orphan": 4, "set_name": 5, "mark_out_of_scope": 6, "delete": 7, "preserve": 8, "no_change": 9, "skip": 10}
SEVERITY_PRIORITY = {"critical": 0, "major": 1, "minor": 2, "unknown": 3}
#: Publication type marker, score, label; the first that applies.
STUDY_LADDER = (
    ("randomized controlled trial", 10.0, "RCT"), ("meta-analysis", 10.0, "Meta-analysis"), ("systematic review", 9.0, "Systematic review"), ("cohort", 7.0, "Cohort study"),
    ("case-control", 6.0, "Case-control study"), ("cross-sectional", 5.0, "Cross-sectional"), ("review", 4.0, "Review"), ("case report", 3.0, "Case report"), ("in vitro", 2.0, "In vitro"),
    ("animal", 2.0, "Animal study"),
)
SAMPLE_SIZE_PATTERNS = (
    r"n\s*=\s*(\d{2,})", r"(\d{2,})\s*(?:subjects|participants|patients|volunteers|individuals)", r"total\s+of\s+(\d{2,})", r"(\d{2,})\s+(?:men|women|children|adults|subjects)",
    r"enrolled\s+(\d{2,})", r"recruited\s+(\d{2,})", r"sample\s+size\s+(?:of\s+)?(\d{2,})",
)
RULE_SAMPLE_PATTERNS = (r"(\d+)\s*(?:participants|subjects|patients|individuals|volunteers)", r"n\s*=\s*(\d+)", r"(?:enrolled|recruited|included)\s+(\d+)")
METABOLIC_TERMS = ("hba1c", "glycemic", "glucose", "insulin", "diabetes", "cholesterol", "ldl", "hdl", "triglyceride", "lipid", "weight", "bmi", "obesity", "body mass", "blood pressure", "hypertension")
GUT_TERMS = ("microbiome", "microbiota", "gut", "probiotic")
FERMENTED_TERMS = ("yogurt", "yoghurt", "kefir", "kimchi", "kombucha", "sauerkraut", "miso", "tempeh", "natto", "fermented", "probiotic", "lactobacillus", "bifidobacterium")
DOMAIN_TERMS = (
    "yogurt", "yoghurt", "kefir", "fermented milk", "fermented dairy", "fermented food", "fermented foods", "kimchi", "kombucha", "natto", "miso", "tempeh", "sauerkraut", "probiotic",
    "probiotics", "synbiotic", "synbiotics", "postbiotic", "postbiotics",
)
OUTCOME_TERMS = (
    "diabetes", "glycemic", "glucose", "insulin", "cholesterol", "lipid", "triglyceride", "blood pressure", "hypertension", "obesity", "overweight", "metabolic", "inflammation", "microbiota",
    "microbiome", "gastrointestinal", "immune",
)
EXCLUDED_TERMS = ("fish", "shrimp", "broiler", "poultry", "piglet", "mouse model", "mice", "rat model", "in vitro", "bibliometric", "patent")
STOPWORDS = ("and", "are", "effect", "effects", "for", "has", "have", "having", "into", "not", "of", "on", "the", "this", "to", "with")
METHOD_CUES = ("aim", "aimed", "aims", "determine", "determined", "evaluate", "evaluated", "investigate", "investigated", "objective", "objectives", "protocol", "purpose", "study")
RESULT_CUES = (
    "associated", "changed", "decrease", "decreased", "difference", "differences", "found", "greater", "improve", "improved", "increase", "increased", "less", "lower", "reduced", "result",
    "results", "significant", "significantly", "showed", "suggest", "suggested", "was", "were",
)
ABSTENTION_MARKERS = (
    "no direct evidence", "no evidence", "not found", "could not find", "does not contain", "not contain", "insufficient evidence", "out of graph", "outside the graph", "no matching claim",
    "no relevant claim", "no direct claim", "no claim associating", "no direct graph", "no direct graph-backed", "no basis to recommend", "cannot cite any pmid", "cannot cite",
    "not supported", "does not support", "do not support",
)
