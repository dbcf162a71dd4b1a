"""Online-retail activity on Spark: active devices, order amounts, coupon
abuse and sale details, as batch reports and as structured streams."""
