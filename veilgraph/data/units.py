"""Units whose quantities may be scaled, as exact (system, code) pairs. Fixed values."""

UCUM = "http://unitsofmeasure.org"
MIMIC = "http://mimic.mit.edu/fhir/mimic/CodeSystem/mimic-units"

CODES = {
    UCUM: ["g", "kg", "mg", "ug", "ng", "pg", "m", "cm", "mm", "[in_i]", "L", "mL", "uL", "fL", "mm[Hg]", "cm[H2O]", "/min", "mg/dL", "g/dL", "mmol/L", "meq/L", "10*3/uL", "10*6/uL", "L/min", "mL/min", "mL/h", "[IU]", "[IU]/L"],
    MIMIC: ["g", "kg", "mg", "mcg", "ng", "pg", "m", "cm", "mm", "Inch", "L", "ml", "mL", "uL", "fL", "mmHg", "mm Hg", "cmH2O", "bpm", "insp/min", "mg/dL", "g/dL", "mmol/L", "mEq/L", "K/uL", "m/uL", "L/min", "ml/hr", "mL/hr", "mL/min", "IU/L"],
}
PAIRS = frozenset((system, code) for system, codes in CODES.items() for code in codes)
