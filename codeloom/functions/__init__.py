"""Part of the code cross-reference engine; see the package README section."""
