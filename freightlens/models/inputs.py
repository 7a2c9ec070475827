"""Model input columns."""

# Numeric inputs, by theme.
NUMERIC_INPUTS = [
    # geography and route
    "customer_lat", "customer_state_avg_days", "customer_state_cat", "customer_zip_code_prefix",
    "customer_zip_prefix_bin", "extreme_longhaul_flag", "log_distance",
    "log_distance_route_ratio", "north_involved", "rare_route_flag", "real_distance_km",
    "remote_state_flag", "route_frequency", "route_variability", "same_state",
    "seller_customer_lat_diff", "seller_customer_lng_diff", "seller_hub_distance",
    "seller_remote_flag", "seller_state_avg_days", "seller_state_cat", "seller_zip_code_prefix",
    "southeast_seller", "state_pair_avg_days", "state_pair_cat", "zip_distance",
    # product, freight and price
    "category_complexity", "freight_per_km", "freight_per_weight", "freight_ratio",
    "freight_tier", "freight_value", "heavy_item_flag", "local_heavy", "log_catalog_age",
    "log_clv", "log_freight", "log_order_value_ratio", "log_volume", "log_weight", "long_heavy",
    "max_dimension_cm", "photos_vs_category_avg", "price_per_km", "product_volume",
    "product_weight_g", "short_heavy", "ultra_cheap_freight",
    # time and load
    "daily_order_count", "fast_season", "holiday_pressure", "log_approval_delay",
    "log_rolling_7d", "payment_approval_delay", "purchase_dayofweek", "purchase_month",
    "quarter", "rolling_7d_orders", "seller_processing_window", "shipping_limit_days",
    # order and payment
    "avg_installment_value", "items_per_order", "log_installments", "log_review_comment",
    "log_total_order_weight", "max_item_price", "order_diversity_x_sellers",
    "payment_installments", "payment_sequential_x_complexity", "payment_value_vs_order_value",
    "total_weight", "unique_sellers_per_order", "weekend_purchase_x_installments",
    # seller and city
    "customer_city_order_density", "customer_city_seller_concentration", "log_city_density",
    "log_seller_age", "seller_age_days", "seller_avg_review", "seller_high_installment_rate",
    "seller_price_range", "seller_review_volatility",
    # interactions
    "city_density_x_clv", "city_density_x_operational_stress", "city_density_x_seller_age",
    "city_density_x_weight_sellers", "clv_x_complexity", "complex_heavy_order", "freight_burden",
    "high_complexity_installment", "high_installment_x_shipping_window",
    "installment_approval_lag", "load_x_shipping_window", "operational_stress",
    "payment_complexity_x_processing", "pressure_x_operational_stress",
    "pressure_x_weight_sellers", "processing_window_x_clv_complexity",
    "processing_window_x_complexity", "processing_window_x_installments",
    "processing_window_x_seller_age", "processing_window_x_weight",
    "seller_hub_distance_x_complexity", "seller_hub_distance_x_review",
    "seller_hub_distance_x_seller_age", "seller_hub_distance_x_shipping_window",
    "seller_reach_x_hub_distance", "shipping_window_x_city_density", "shipping_window_x_clv",
    "shipping_window_x_complexity", "shipping_window_x_installment_lag",
    "shipping_window_x_operational_stress", "shipping_window_x_seller_age",
    "shipping_window_x_seller_review", "weight_x_sellers",
]

# Category inputs.
CATEGORY_INPUTS = ["customer_region", "customer_state", "product_category_name",
                   "seller_region", "seller_state"]

# Inputs of the component and residual analyses.
COMPONENT_INPUTS = ["distance_weight", "freight_per_km", "freight_value", "product_volume",
                    "product_weight_g", "real_distance_km", "route_frequency",
                    "seller_order_volume"]
