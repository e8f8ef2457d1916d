"""Search, result shaping, and maintenance of the tables behind them."""
