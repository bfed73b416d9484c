"""Reading files with detected formats, inferring types, writing results."""
