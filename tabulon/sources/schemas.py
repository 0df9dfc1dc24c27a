"""Declared schemas of the canonical tables and of source records. Names and types of stored columns."""

CANONICAL = {
    "tournament": "tid string, cobra_id long, abr_id long, date date, type string, tier string, format string, restriction_id string, card_set string, country string, online boolean, players int, cut_size int, has_games boolean, deck_visibility string, decklist_coverage double, name string, swiss_format string",
    "entry": "tid string, entry_no int, cut_rank int, made_cut boolean, corp_identity string, runner_identity string, points int, cobra_pid long, abr_swiss_rank int",
    "deck": "deck_id string, tid string, entry_no int, side string, identity_card string, source string, source_ref string, card_count int, plain_text string, content_hash string, comparison string, legal boolean, issues string",
    "deck_card": "deck_id string, card_id string, qty int, printing_id string",
    "game": "tid string, stage int, round int, table int, side string, corp_entry int, runner_entry int, result string, elimination boolean",
}

PRIMARY_KEYS = {
    "tournament": ["tid"],
    "entry": ["tid", "entry_no"],
    "deck": ["deck_id"],
    "deck_card": ["deck_id", "card_id"],
    "game": ["tid", "stage", "round", "table", "side"],
}

#: Columns that an imported deck file must have.
IMPORT_COLUMNS = ["name", "identity", "card", "card_count"]
