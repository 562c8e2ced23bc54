"""The warehouse layers and every analytic dataset built on top of them."""
