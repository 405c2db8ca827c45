"""Where binary data comes from and goes to."""
