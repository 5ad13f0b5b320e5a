"""Queries of the text-corpus operators by name, and the SQL they are compared with."""

from __future__ import annotations

from folioflow.llm import boilerplate, duplicates, encoding, leaks, lookalikes, packing, quality, truncation

QUERIES = {
    "p1_found": encoding.p1_found,
    "p1_garbled": encoding.p1_garbled,
    "p2_found": duplicates.p2_found,
    "p2_ledger": duplicates.p2_ledger,
    "p3_found": lookalikes.p3_found,
    "p3_unified": lookalikes.p3_unified,
    "p3_groups": lookalikes.p3_groups,
    "p4_found": boilerplate.p4_found,
    "p4_cleaned": boilerplate.p4_cleaned,
    "p4_cut": boilerplate.p4_cut,
    "p5_found": truncation.p5_found,
    "p5_shares": truncation.p5_shares,
    "p7_packed": packing.p7_packed,
    "p7_fill": packing.p7_fill,
    "p8_found": leaks.p8_found,
    "p8_report": leaks.p8_report,
    "p8_locations": leaks.p8_locations,
    "p8_clean": leaks.p8_clean,
    "p9_found": quality.p9_found,
    "p9_statistics": quality.p9_statistics,
}

ORACLE_SQL: dict[str, str] = {
    "p2_found": duplicates.P2_FOUND_SQL,
    "p2_ledger": duplicates.P2_LEDGER_SQL,
    "p4_found": boilerplate.P4_FOUND_SQL,
    "p4_cleaned": boilerplate.P4_CLEANED_SQL,
    "p8_found": leaks.P8_FOUND_SQL,
    "p8_report": leaks.P8_REPORT_SQL,
    "p8_locations": leaks.P8_LOCATIONS_SQL,
    "p8_clean": leaks.P8_CLEAN_SQL,
}
