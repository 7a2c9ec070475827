"""Declared column types of the source tables: reading never infers types."""

from __future__ import annotations

# The columns in use and their types.
SCHEMAS = {
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
        "order_estimated_delivery_date": "timestamp_ntz",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "timestamp_ntz",
        "price": "double",
        "freight_value": "double",
    },
    "order_payments": {
        "order_id": "string",
        "payment_sequential": "int",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": "double",
    },
    "order_reviews": {
        "order_id": "string",
        "review_score": "int",
        "review_comment_message": "string",
    },
    "products": {
        "product_id": "string",
        "product_category_name": "string",
        "product_photos_qty": "double",
        "product_weight_g": "double",
        "product_length_cm": "double",
        "product_height_cm": "double",
        "product_width_cm": "double",
    },
    "sellers": {
        "seller_id": "string",
        "seller_zip_code_prefix": "int",
        "seller_city": "string",
        "seller_state": "string",
    },
    "customers": {
        "customer_id": "string",
        "customer_zip_code_prefix": "int",
        "customer_city": "string",
        "customer_state": "string",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "int",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
    },
}

# Free text may hold line breaks inside quotes; such files cannot be split.
MULTI_LINE_TABLES = {"order_reviews"}
