"""Word lists, factors and limits that decide which rows and results are right."""

# --- fixed values: record validity -------------------------------------------------------------
VALIDITY_COMMENTS = [
    "Values appear to be an order of magnitude different from previously reported, so units may be incorrect",
    "Potential transcription error",
]
VALIDITY_DESCRIPTIONS = [
    "Values for this activity type are unusually large/small, so may not be accurate",
    "Values appear to be an order of magnitude different from previously reported, so units may be incorrect",
]

# --- fixed values: units and record types ------------------------------------------------------
UNIT_FACTORS = {"10'5pM": 100.0, "10'6pM": 1000.0, "10'3pM": 1.0, "nM": 1.0}
NORMAL_UNIT = "nM"
TYPE_LINEAR = "IC50"
TYPE_LOG = "Log IC50"
TYPE_NEG_LOG = "pIC50"
TYPE_LOG_NANO = "Log IC50(nM)"

# --- fixed values: thresholds ------------------------------------------------------------------
MAD_MAX = 1.0
EXACT_RELATION = "="
RANGE_MAX = 10000.0
TRAIN_FRACTION = 0.8
VALIDATION_FRACTION = 0.15
VARIANCE_MIN = 0.0475
CORRELATION_MAX = 0.90
SEED = 50
BITS = 1024
RADIUS = 2
TARGET_DIGITS = 5
MIN_RECORDS = 10
NO_GROUP = "__NO_SCAFFOLD__"
NULL_LABEL = "<NULL>"
QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
TOP_PERCENTS = [1, 5, 10]

# --- fixed values: columns pruned from raw records ---------------------------------------------
PRUNED_COLUMNS = [
    "qudt_units", "uo_units", "toid", "document_chembl_id", "_journal", "_year", "assay_descriptions",
    "activity_comment", "upper_value", "molecule_pref_name", "type", "units", "value", "document_journal",
    "document_year", "assay_description", "activity_id", "activity_properties", "ligand_efficiency",
]
PRUNED_BEFORE_FEATURES = [
    "action_type", "target_pref_name", "target_tax_id", "bao_endpoint", "assay_chembl_id", "target_chembl_id",
    "record_id", "molecule_chembl_id", "parent_molecule_chembl_id", "bao_label", "standard_type",
    "standard_units", "standard_flag",
]
PRUNED_AFTER_CONSENSUS = ["pchembl_value", "potential_duplicate", "relation"]

# --- fixed values: model features --------------------------------------------------------------
DESCRIPTORS = [
    "MolWt", "MolLogP", "NumHDonors", "NumHAcceptors", "TPSA", "MaxPartialCharge", "MinPartialCharge",
    "NumHeteroatoms", "NumRotatableBonds", "FractionCSP3", "NumAromaticRings", "RingCount",
    "NumAliphaticNitrogens", "NumFormalCharge",
]
NULLABLE_DESCRIPTORS = ["MaxPartialCharge", "MinPartialCharge"]
BIT_PREFIX = "morgan_"
IDENTIFIERS = [
    "InChIkey", "molecule_chembl_id", "assay_chembl_id", "target_chembl_id", "record_id",
    "parent_molecule_chembl_id", "cleaned_smiles", "scaffold", "Scaffold_InChI",
]
TARGET_TOKENS = ["pic50", "ic50", "standard_value", "activity", "potency"]

# --- fixed values: vertex category ranges (low, high, shift) and edge categories ---------------
VERTEX_RANGES = {
    "atomic_number": (0, 118, 0), "degree": (0, 6, 0), "formal_charge": (-5, 5, 5), "hybridization": (0, 5, 0),
    "aromaticity": (0, 1, 0), "hydrogen_count": (0, 6, 0), "ring_membership": (0, 1, 0),
}
BOND_TYPES = ["SINGLE", "DOUBLE", "TRIPLE", "AROMATIC"]
BOND_STEREO = ["STEREONONE", "STEREOANY", "STEREOZ", "STEREOE", "STEREOCIS", "STEREOTRANS"]
COMMON_ELEMENTS = [1, 5, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, 19, 20, 25, 26, 27, 29, 30, 34, 35, 53]

# --- fixed values: single-fragment counter-ions removed from dotted notation -------------------
SALT_FRAGMENTS = [
    "Cl", "Br", "I", "F", "[Cl-]", "[Br-]", "[I-]", "[F-]", "[Li]", "[Na]", "[K]", "[Ca]", "[Mg]",
    "[Li+]", "[Na+]", "[K+]", "[Ca+2]", "[Mg+2]", "O", "N", "[OH-]",
]
