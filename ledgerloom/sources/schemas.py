"""Declared schemas; nothing is inferred from data."""

LANDING_TRANSACTIONS = (
    "id bigint, date timestamp_ntz, client_id bigint, card_id bigint, amount string, use_chip string, "
    "merchant_id bigint, merchant_city string, merchant_state string, zip string, mcc bigint, errors string"
)
# the same message before any field is trusted
RAW_TRANSACTIONS = (
    "id string, date string, client_id string, card_id string, amount string, use_chip string, "
    "merchant_id string, merchant_city string, merchant_state string, zip string, mcc string, errors string"
)
CARDS = (
    "id bigint, client_id bigint, card_brand string, card_type string, card_number string, expires string, "
    "cvv string, has_chip string, num_cards_issued int, credit_limit string, acct_open_date string, "
    "year_pin_last_changed int, card_on_dark_web string"
)
USERS = (
    "id bigint, current_age int, retirement_age int, birth_year int, birth_month int, gender string, "
    "address string, latitude double, longitude double, per_capita_income string, yearly_income string, "
    "total_debt string, credit_score int, num_credit_cards int"
)
MCC_CODES = "mcc_code string, category_name string"
LABELS = "transaction_id string, is_fraud string"
