"""Tables, and the observation views derived from them."""
