"""Operations for preparing listing texts as training data; nothing else in the library imports this package."""
