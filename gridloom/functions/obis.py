"""OBIS codes of electricity meters: extraction and the catalogue of quantities and kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import fixed_table

# Fixed value: medium 1, channel, quantity, kind. A third group stays outside of the code.
PATTERN = r"1-\d*:\d*\.\d*"
MEDIUM = "Elektrizität"

# Quantities by code as (code, name, unit, short name); 21 to 80 are those of the three phases.
QUANTITIES = [
    ("1", "Wirkleistung (+)", "kWh", "Bezug"),
    ("2", "Wirkleistung (-)", "kWh", "Lieferung"),
    ("3", "Blindenergie (+)", "kvarh", "Blinden. Bezug"),
    ("4", "Blindenergie (-)", "kvarh", "Blinden. Lieferung"),
    ("5", "Blindenergie QI", "kvarh", "Blinden. QI"),
    ("6", "Blindenergie QII", "kvarh", "Blinden. QII"),
    ("7", "Blindenergie QIII", "kvarh", "Blinden. QIII"),
    ("8", "Blindenergie QIV", "kvarh", "Blinden. QIV"),
    ("9", "Scheinenergie (+)", "kVA", "Scheinen. Bezug"),
    ("10", "Scheinenergie (-)", "kVA", "Scheinen. Lieferung"),
    ("11", "Strom", "A", "Strom"),
    ("12", "Spannung", "V", "Spannung"),
    ("13", "Leistungsfaktor Durchschnitt", "-", "P-Faktor"),
    ("14", "Frequenz", "Hz", "Frequenz"),
    ("15", "Wirkenergie QI+QII+QIII+QIV", "kWh", "Wirken. QI+QII+QIII+QIV"),
    ("16", "Wirkenergie QI+QII+QIII+QIV", "kWh", "Wirken. QI+QII+QIII+QIV"),
    ("17", "Wirkenergie QI", "kWh", "Wirken. QI"),
    ("18", "Wirkenergie QII", "kWh", "Wirken. QII"),
    ("19", "Wirkenergie QIII", "kWh", "Wirken. QIII"),
    ("20", "Wirkenergie QIV", "kWh", "Wirken. QIV"),
    ("21", "Wirkenergie L1 (+)", "kWh", "L1 Bezug"),
    ("22", "Wirkenergie L1 (-)", "kWh", "L1 Lieferung"),
    ("23", "Blindenergie L1 (+)", "kvarh", "L1 Blinden. Bezug"),
    ("24", "Blindenergie L1 (-)", "kvarh", "L1 Blinden. Lieferung"),
    ("25", "Blindenergie L1 QI", "kvarh", "L1 Blinden. QI"),
    ("26", "Blindenergie L1 QII", "kvarh", "L1 Blinden. QII"),
    ("27", "Blindenergie L1 QIII", "kvarh", "L1 Blinden. QIII"),
    ("28", "Blindenergie L1 QIV", "kvarh", "L1 Blinden. QIV"),
    ("29", "Scheinenergie L1 (+)", "kVA", "L1 Scheinen. Bezug"),
    ("30", "Scheinenergie L1 (-)", "kVA", "L1 Scheinen. Lieferung"),
    ("31", "I L1", "A", "L1 Strom"),
    ("32", "U PH-N L1", "V", "L1 Spannung"),
    ("33", "Leistungsfaktor L1", "-", "L1 P-Faktor"),
    ("34", "Frequenz L1", "Hz", "L1 Frequenz"),
    ("35", "Wirkenergie L1 QI+QII+QIII+QIV", "kWh", "L1 Wirken. QI+QII+QIII+QIV"),
    ("36", "Wirkenergie L1 QI+QII+QIII+QIV", "kWh", "L1 Wirken. QI+QII+QIII+QIV"),
    ("37", "Wirkenergie L1 QI", "kWh", "L1 Wirken. QI"),
    ("38", "Wirkenergie L1 QII", "kWh", "L1 Wirken. QII"),
    ("39", "Wirkenergie L1 QIII", "kWh", "L1 Wirken. QIII"),
    ("40", "Wirkenergie L1 QIV", "kWh", "L1 Wirken. QIV"),
    ("41", "Wirkenergie L2 (+)", "kWh", "L2 Bezug"),
    ("42", "Wirkenergie L2 (-)", "kWh", "L2 Lieferung"),
    ("43", "Blindenergie L2 (+)", "kvarh", "L2 Blinden. Bezug"),
    ("44", "Blindenergie L2 (-)", "kvarh", "L2 Blinden. Lieferung"),
    ("45", "Blindenergie L2 QI", "kvarh", "L2 Blinden. QI"),
    ("46", "Blindenergie L2 QII", "kvarh", "L2 Blinden. QII"),
    ("47", "Blindenergie L2 QIII", "kvarh", "L2 Blinden. QIII"),
    ("48", "Blindenergie L2 QIV", "kvarh", "L2 Blinden. QIV"),
    ("49", "Scheinenergie L2 (+)", "kVA", "L2 Scheinen. Bezug"),
    ("50", "Scheinenergie L2 (-)", "kVA", "L2 Scheinen. Lieferung"),
    ("51", "I L2", "A", "L2 Strom"),
    ("52", "U PH-N L2", "V", "L2 Spannung"),
    ("53", "Leistungsfaktor L2", "-", "L2 P-Faktor"),
    ("54", "Frequenz L2", "Hz", "L2 Frequenz"),
    ("55", "Wirkenergie L2 QI+QII+QIII+QIV", "kWh", "L2 Wirken. QI+QII+QIII+QIV"),
    ("56", "Wirkenergie L2 QI+QII+QIII+QIV", "kWh", "L2 Wirken. QI+QII+QIII+QIV"),
    ("57", "Wirkenergie L2 QI", "kWh", "L2 Wirken. QI"),
    ("58", "Wirkenergie L2 QII", "kWh", "L2 Wirken. QII"),
    ("59", "Wirkenergie L2 QIII", "kWh", "L2 Wirken. QIII"),
    ("60", "Wirkenergie L2 QIV", "kWh", "L2 Wirken. QIV"),
    ("61", "Wirkenergie L3 (+)", "kWh", "L3 Bezug"),
    ("62", "Wirkenergie L3 (-)", "kWh", "L3 Lieferung"),
    ("63", "Blindenergie L3 (+)", "kvarh", "L3 Blinden. Bezug"),
    ("64", "Blindenergie L3 (-)", "kvarh", "L3 Blinden. Lieferung"),
    ("65", "Blindenergie L3 QI", "kvarh", "L3 Blinden. QI"),
    ("66", "Blindenergie L3 QII", "kvarh", "L3 Blinden. QII"),
    ("67", "Blindenergie L3 QIII", "kvarh", "L3 Blinden. QIII"),
    ("68", "Blindenergie L3 QIV", "kvarh", "L3 Blinden. QIV"),
    ("69", "Scheinenergie L3 (+)", "kVA", "L3 Scheinen. Bezug"),
    ("70", "Scheinenergie L3 (-)", "kVA", "L3 Scheinen. Lieferung"),
    ("71", "I L3", "A", "L3 Strom"),
    ("72", "U PH-N L3", "V", "L3 Spannung"),
    ("73", "Leistungsfaktor L3", "-", "L3 P-Faktor"),
    ("74", "Frequenz L3", "Hz", "L3 Frequenz"),
    ("75", "Wirkenergie L3 QI+QII+QIII+QIV", "kWh", "L3 Wirken. QI+QII+QIII+QIV"),
    ("76", "Wirkenergie L3 QI+QII+QIII+QIV", "kWh", "L3 Wirken. QI+QII+QIII+QIV"),
    ("77", "Wirkenergie L3 QI", "kWh", "L3 Wirken. QI"),
    ("78", "Wirkenergie L3 QII", "kWh", "L3 Wirken. QII"),
    ("79", "Wirkenergie L3 QIII", "kWh", "L3 Wirken. QIII"),
    ("80", "Wirkenergie L3 QIV", "kWh", "L3 Wirken. QIV"),
    ("81", "Phasenwinkel", "-", "Phasenwinkel"),
    ("82", "Einheitslose Mengen (z.B. Impulse)", "-", "Einheitslose Mengen"),
    ("91", "I Neutralleiter", "A", "N Strom"),
    ("92", "U Neutralleiter", "V", "N Spannung"),
]

# Kinds of measurement by code.
KINDS = [
    ("0", "Mittelwert Abrechnungsperiode (seit letztem Reset)"),
    ("1", "Kumulativ Minimum 1"),
    ("2", "Kumulativ Maximum 1"),
    ("3", "Minimum 1"),
    ("4", "Aktueller Mittelwert 1"),
    ("5", "Letzter Mittelwert 1"),
    ("6", "Maximum 1"),
    ("7", "Momentanwert"),
    ("8", "Zeit Integral 1 - Zählerstand"),
    ("9", "Zeit Integral 2 - Verbrauch / Vorschub"),
    ("10", "Zeit Integral 3"),
    ("11", "Kumulativ Minimum 2"),
    ("12", "Kumulativ Maximum 2"),
    ("13", "Minimum 2"),
    ("14", "Aktueller Mittelwert 2"),
    ("15", "Letzter Mittelwert 2"),
    ("16", "Maximum 2"),
    ("17", "Momentanwert 2"),
    ("18", "Zeit Integral 2 1 - Zählerstand"),
    ("19", "Zeit Integral 2 2 - Verbrauch / Vorschub"),
    ("20", "Zeit Integral 3 2"),
    ("21", "Kumulativ Minimum 3"),
    ("22", "Kumulativ Maximum 3"),
    ("23", "Minimum 3"),
    ("24", "Aktueller Mittelwert 3"),
    ("25", "Letzter Mittelwert 3"),
    ("26", "Maximum 3"),
    ("27", "Aktueller Mittelwert 5"),
    ("28", "Aktueller Mittelwert 6"),
    ("29", "Zeit Integral 5 - Lastprofil Aufzeichnungsperiode 1"),
    ("30", "Zeit Integral 6 - Lastprofil Aufzeichnungsperiode 2"),
    ("31", "Untere Grenzwertschwelle"),
    ("32", "Unterer Grenzwert Ereigniszähler"),
    ("33", "Unterer Grenzwert Dauer"),
    ("34", "Unterer Grenzwert Größe"),
    ("35", "Oberer Grenzwertschwelle"),
    ("36", "Oberer Grenzwert Ereigniszähler"),
    ("37", "Oberer Grenzwert Dauer"),
    ("38", "Oberer Grenzwert Größe"),
    ("58", "Zeit Integral 4 - Test Zeit Integral"),
    ("131", "Schichtwert"),
    ("132", "Tageswert"),
    ("133", "Wochenwert"),
    ("134", "Monatswert"),
    ("135", "Quartalswert"),
    ("136", "Jahreswert"),
]


def quantity_rows() -> list[tuple[str, str, str, str]]:
    """(code, name, unit, short name) of all 84 quantities."""
    return QUANTITIES


def catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(quantities, kinds): two fixed tables of 84 and 46 rows."""
    quantities = fixed_table(spark, quantity_rows(), "obis_quantity, quantity, obis_unit, short_name")
    return quantities, fixed_table(spark, KINDS, "obis_kind, kind")


def code_of(text: Column) -> Column:
    """First OBIS code in a text, null if there is none."""
    return F.nullif(F.regexp_extract(text, PATTERN, 0), F.lit(""))


def code_parts(code: Column) -> tuple[Column, Column]:
    """(quantity, kind) numbers of a code."""
    parts = F.split(F.replace(F.replace(code, F.lit(":"), F.lit("-")), F.lit("."), F.lit("-")), "-")
    return F.get(parts, 2), F.get(parts, 3)
