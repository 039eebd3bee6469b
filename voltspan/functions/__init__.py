"""Part of voltspan; see the package README."""
